"""The training-data operators against brute force, exact round trips, SQL and held-out accuracy."""

import hashlib
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import ann, bpe, chat, components, linededup, packing, queries, shards, similar, simhash, tokens, toxicity, urlfilter, winnow

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "a", "A b", "a  b   c \n d", "é漢🙂 x", "<|endoftext|> y", "the " * 3000, "x" * 20000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*ODD, "A b", None])], "doc_id long, text string, fingerprint string")


def test_sql_queries(spark):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        want = c.sql(sql)
        cols = sorted(got.columns)
        assert sorted(map(tuple, got.select(cols).collect()), key=repr) == sorted(want.select(*cols).fetchall(), key=repr), name


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance):
    label = {i: i for i in prints}
    ids = sorted(prints)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= distance and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    label = brute_components(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_simhash_forest_links_everything():
    rng = np.random.default_rng(5)
    for distance in (1, 3, 11):
        base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, distance), dtype=np.uint64), axis=1) for b in base]))
        found = set()
        for start in range(distance + 1):
            # Buckets of the first segment alone hold all that the finer keys hold.
            at, width = simhash.ring(distance)[start]
            key = (fps << np.uint64(at) | fps >> np.uint64((64 - at) % 64)) >> np.uint64(64 - width) if at else fps >> np.uint64(64 - width)
            for k in np.unique(key):
                part = np.flatnonzero(key == k)
                if len(part) > 1:
                    found |= {(part[a], part[b]) for a, b in simhash.forest(fps[part], start, distance)}
        label = list(range(len(fps)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in found:
            assert int(np.bitwise_count(fps[a] ^ fps[b])) <= distance
            label[max(root(a), root(b))] = min(root(a), root(b))
        want = brute_components(dict(enumerate(fps.tolist())), distance)
        assert [want[root(i)] for i in range(len(fps))] == [want[i] for i in range(len(fps))]
        assert len({root(i) for i in range(len(fps))}) == len(set(want.values()))


def test_simhash_edges(spark, docs):
    got = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == docs.count() and got[0].fp == 0 and {got[i].component for i in (0, 1, 2, 3, 12)} == {0} and got[11].component == 5
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_winnow_matches_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 5, 12, 13, 33, 200):
        text = "".join(rng.choice(list("ab"), n))
        h = winnow.gram_hashes(winnow.points(text), min(12, n)).tolist()
        w = min(21, len(h))
        picked = sorted({max((i for i in range(s, s + w)), key=lambda i: (-h[i], i)) for s in range(len(h) - w + 1)})
        positions, hashes = winnow.winnow(text)
        assert positions.tolist() == picked and hashes.tolist() == [h[i] for i in picked]
        back = winnow.decode(winnow.encode(positions, hashes))
        assert back[0].tolist() == picked and back[1].tolist() == hashes.tolist()


def test_winnow_query(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    got = {r.doc_id: r for r in winnow.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for a, b in zip(rows, rows[1:] + rows[:1]):
        x, y = a.text or "", b.text or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == winnow.encode(*winnow.winnow(x)) and r.edited_fingerprint == winnow.encode(*winnow.winnow(edited))
        own, changed, after = (set(winnow.winnow(t)[1].tolist()) for t in (x, edited, y))
        assert r.near_edited == (len(own & changed) / len(own | changed) if own | changed else 1) and r.near_next == (len(own & after) / len(own | after) if own | after else 1)
    with pytest.raises(ValueError):
        winnow.winnow("a" * 1000, 12, 256)
    assert winnow.edited_fingerprints(docs.limit(0)).count() == 0


def test_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert np.mean([(b > g) for b in bad for g in good]) > 0.8  # 0.86 measured at this size
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.count() == docs.count() and none.agg(F.max("predicted")).first()[0] == 0


def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards(spark, docs):
    for frame in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        text = {r.doc_id: r.text or "" for r in frame.collect()}
        got = shards.shard(frame).collect()
        assert sorted(r.doc_id for r in got) == sorted(text)
        for s in range(8):
            mine = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
            assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)
        for r in got:
            assert (r.shard, r.grown_shard) == (brute_jump(r.doc_id, 8), brute_jump(r.doc_id, 9)) and r.grown_shard in (r.shard, 8)
            assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    assert shards.shard(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    got, fill = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = list(struct.unpack(f"<{p.length}I", p.ids))
        assert p.start == len(got.setdefault(p.doc_id, [])) and p.ids_crc32 == zlib.crc32(p.ids) and p.doc_tokens == len(want[p.doc_id])
        got[p.doc_id] += ids
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for f in fill.values():
        at = 0
        for offset, length in sorted(f):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_assign_is_tight():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 6000, 300).tolist()
    pieces = packing.assign(lengths)
    assert sum(p[2] for p in pieces) == sum(lengths) and len({p[3] for p in pieces}) == -(-sum(lengths) // 2048)


def test_assign_equals_a_plain_search():
    """The longest first, each to the cheapest sequence with room; what fits nowhere fills the cheapest with any room."""
    rng = np.random.default_rng(4)
    for case in range(60):
        length = int(rng.integers(3, 40))
        lengths = rng.integers(1, int(rng.integers(2, 100)), int(rng.integers(1, 60))).tolist()
        m = -(-sum(lengths) // length)
        room, fill, want = [length] * m, [0.0] * m, []
        items = [(min(length, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, length)]
        for n, d, at in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
            while n:
                fits = [s for s in range(m) if room[s] >= n] or [s for s in range(m) if room[s]]
                s = min(fits, key=lambda s: (fill[s], s))
                part = min(n, room[s])
                want.append((d, at, part, s, length - room[s]))
                room[s], fill[s], at, n = room[s] - part, fill[s] + packing.cost(part), at + part, n - part
        assert packing.assign(lengths, length) == want, case


def test_fit_matches_plain_steps():
    """Naive Bayes log-count ratios, and the first step of the logistic loss, over features counted one by one."""
    texts, labels = ["you bad bad", "so good", "bad", "fine and good", ""], np.array([1, 0, 1, 0, 0])
    sets = [set(np.concatenate([np.zeros(0, int), *toxicity.grams(t)]).tolist()) for t in texts]
    assert [set(toxicity.features(t).tolist()) for t in texts] == sets
    seen = {0: {}, 1: {}}
    for s, y in zip(sets, labels):
        for f in s:
            seen[int(y)][f] = seen[int(y)].get(f, 0) + 1
    total = {y: sum(seen[y].values()) + toxicity.BUCKETS for y in (0, 1)}
    ratio = {f: np.log((seen[1].get(f, 0) + 1) / total[1]) - np.log((seen[0].get(f, 0) + 1) / total[0]) for f in set().union(*sets)}
    model = toxicity.fit(texts, labels, rounds=1)
    share = {1: toxicity.TOXIC_SHARE / 2, 0: (1 - toxicity.TOXIC_SHARE) / 3}
    for f, r in ratio.items():
        slope = sum((0.5 - y) * share[int(y)] / max(1, len(s)) ** 0.5 for s, y in zip(sets, labels) if f in s) * r
        step = -0.05 * slope / (abs(slope) + 1e-9)
        assert abs(model[f] - step * r) < 1e-5
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    assert scorer("bad") > 0.5 > scorer("good") and scorer("") == scorer("  ")
    for t in texts:
        z = sum(float(scorer.weight[f]) for f in toxicity.features(t)) / max(1, len(toxicity.features(t))) ** 0.5 + scorer.offset
        assert abs(scorer(t) - 1 / (1 + np.exp(-z))) < 1e-5


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x" * 50)] * 40 + [(1, f"text {i}") for i in range(30)] + [(i, "y" * 90) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    got = toxicity.labelled_texts(docs, labels, (10, 7)).collect()
    assert {(r.id, r.text) for r in got} <= {(r.doc_id, r.text) for r in docs.collect()} and len({(r.id, r.text) for r in got}) == len(got)
    assert sum(r.label == 0 for r in got) == 10 and sum(r.label == 1 for r in got) == 7
    monkeypatch.setattr(toxicity, "CHARS", 300)
    assert sum(len(r.text) for r in toxicity.labelled_texts(docs, labels, (10, 7)).collect()) <= 300


def hostile(spark):
    """Nulls in every column, repeated rows, and columns named like those that operators make themselves."""
    names = ["row", "id", "text_", "version", "words", "h", "key", "score", "ld_lines", "ld_dropped", "ld_kept", "fp", "label", "b_id", "a.b", "n_chars"]
    rows = [(1, "a bad line\nb", *["c"] * 16, 12), (1, "a bad line\nb", *["c"] * 16, 12), (None, None, *[None] * 17), (2, "", *["d"] * 16, 0), (3, "é" * 5000, *["e"] * 16, 5000)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in [*names[:-1], "component"]) + ", n_chars long")


def test_hostile_tables(spark):
    df, labels = hostile(spark), spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    names = df.columns
    for rows in (df, df.limit(0)):
        n = rows.count()
        for f in (corpus_pipeline.drop_toxic, corpus_pipeline.dedup_lines, corpus_pipeline.dedup_near):
            got = f(spark, rows, SF)
            assert got.columns == names and {str(r) for r in got.collect()} <= {str(r) for r in rows.collect()}, f.__name__
        lines = linededup.dedup_lines(rows)
        assert lines.columns[: len(names)] == names and lines.columns[-3:] == ["ld_lines_", "ld_dropped_", "ld_kept_"] and lines.count() == n
        tox = toxicity.toxicity(rows, labels)
        assert tox.columns == ["doc_id", "held_out", "score", "predicted"] and tox.count() == n
        assert shards.shard(rows).count() == n and packing.pack(rows, public_tokenizers.path("byte_bpe_50k.json")).where("start = 0").count() == n
        assert bpe.token_digests(rows, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == n
        assert winnow.edited_fingerprints(rows).count() == n and simhash.near_duplicates(rows).count() == n
    kept = corpus_pipeline.dedup_near(spark, df, SF).collect()
    # Blank texts are one group, whose smallest id is the null one; of equal rows one stays.
    assert sorted(map(str, (r.doc_id for r in kept))) == ["1", "3", "None"]
    twice = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    assert set(twice) == {1, 2, 3, None} and 0 <= twice[None].score <= 1 and twice[None].score == twice[2].score


def test_hostile_searches(spark):
    vectors = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 2), (1, [0.5, 0.5], 2), (2, None, None), (None, [1.0, 1.0], 3)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, salt int")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
    pages = spark.createDataFrame([(1, "http://a.org/", "x"), (1, "http://a.org/", "x"), (None, None, None)], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    assert sorted((str(r.page_id), r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()) == [("1", "org/", "allow"), ("1", "org/", "allow"), ("None", None, "allow")]
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    # More hits of one rule than a join deals together.
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.org/"), F.col("id")).alias("url"))
    assert urlfilter.judge(many, rules).where("rule = 'org/'").count() == 3000


def test_line_dedup_of_a_frequent_line(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common\nown "), F.col("id"), F.lit("\n\tCOMMON ")).alias("text"))
    got = {r.doc_id: (r.ld_lines, r.ld_dropped, r.ld_kept) for r in linededup.dedup_lines(df, keep_first=True).collect()}
    assert got == {i: (3, 2, f"own {i}") if i else (3, 1, "Common\nown 0") for i in range(3000)}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Groups above the size of a part, of a block and of a join's frequent key."""
    for name, value in (("LARGE", 8), ("BLOCK", 16)):
        monkeypatch.setattr(similar, name, value)
    rng = np.random.default_rng(17)
    texts = {}
    for g, n in enumerate((120, 60, 5)):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for i in range(n):
            texts[1000 * g + i] = edited(rng, words, True, int(rng.integers(1, 6)))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_near(spark, frame, SF).collect()) == brute_kept(texts)


def test_tokenizers_agree():
    ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ours, fast = bpe.BytePairs(ranks_path, public_tokenizers.PATTERN), tokens.FastTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "é", "'s", "12", "!", "\u00a0", "\u3000", "漢", "🙂", "\x1c", "\x85", "A"], rng.integers(0, 40))) for _ in range(500)]
    for t in texts:
        ids = ours.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == lib.encode_ordinary(t) and ours.decode(ids) == t.encode()
        assert fast.ids(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_query(spark, docs):
    got = {r.doc_id: r for r in bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    ours = bpe.BytePairs(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    for r in docs.collect():
        ids = lib.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    both = bpe.decode_ids(bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    assert bpe.token_digests(docs.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_line_dedup(spark):
    rows = [(i, " Common \nown %d\ncommon" % i) for i in range(10)] + [(20, None), (21, ""), (22, "x\n\nx"), (22, "x\n\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in linededup.dedup_lines(df, 10, 1).select("doc_id", "ld_lines", "ld_dropped", "ld_kept").collect())
    assert got == [*[(i, 3, 2, f"own {i}") for i in range(10)], (20, 1, 0, ""), (21, 1, 0, ""), (22, 3, 0, "x\n\nx"), (22, 3, 0, "x\n\nx")]
    first = {r.doc_id: r.ld_kept for r in linededup.dedup_lines(df, 10, 1, keep_first=True).collect()}
    assert first[0] == " Common \nown 0" and first[3] == "own 3"
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_chat(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\l<\\\\<l\n\\n", "", "a\\", "<turn>user\nx</turn>\n"]
    rows = [(1, i, "assistant" if i % 2 else "us<e\nr\\", t) for i, t in enumerate(nasty)] + [(2, 0, None, None), (None, 0, "user", "q")]
    made = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in made.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [(r[2], r[3]) for r in rows[:5]], 2: [("", "")], None: [("user", "q")]}
    digest = {r.conv_id: r for r in chat.read_back(made).collect()}[1]
    assert digest.loss_sha256 == hashlib.sha256((nasty[1] + nasty[3]).encode()).hexdigest()


def test_chat_order_and_mask(spark):
    rows = [(1, 0, "assistant", "Z"), (1, 0, "assistant", "<"), (1, None, "user", "first"), (1, 0, "assistant", "<"), (2, 0, "user", "only")]
    made = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in made.collect()}
    assert got[1].formatted == "".join(f"<turn>{r}\n{t}</turn>\n" for r, t in [("user", "first"), ("assistant", "\\l"), ("assistant", "\\l"), ("assistant", "Z")])
    assert [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss] == ["\\l", "\\l", "Z"] and got[2].loss == []
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert (back[1].loss_chars, back[1].loss_sha256) == (3, hashlib.sha256(b"<<Z").hexdigest()) and back[2].loss_chars == 0
    assert chat.read_back(made.limit(0)).count() == 0 and chat.format_turns(chat.canonical_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_chat_layouts(spark):
    payloads = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"id":3}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"instruction":"q","input":"","output":"a"}', '{"prompt":"q","completion":"a"}', '{"question":"q","answer":"a"}', '{"other":1}', None]
    df = spark.createDataFrame(list(enumerate(payloads)), "conv_id long, payload string")
    got = {}
    for r in sorted(chat.json_turns(df).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    # What has no mapping is there, without a turn.
    assert got == {i: [("user", "q"), ("assistant", "a")] for i in range(5)} | {5: [(None, None)], 6: [(None, None)]}
    named = spark.createDataFrame([(1, '{"messages":[{"name":"n","role":"user","content":"q","weight":1}]}')], "conv_id long, payload string")
    assert [(r.role, r.text, r.layout) for r in chat.json_turns(named).collect()] == [("user", "q", "messages")]
    assert spark.range(1).select(F.xxhash64(F.lit("a{b,c}"))).first()[0] == chat.fingerprint("a{b,c}")
    with pytest.raises(ValueError):
        chat.canonical_turns(df)


def test_nearest_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(200 + i, [1.0] * 8) for i in range(60)] + [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    good = rows[:260]
    for q, v in good[::20]:
        want = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q))[:20]
        assert [got[q][k + 1][0] for k in range(20)] == [i for _, i in want]
    assert set(got) == {q for q, _ in good[::20]}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Org", "http://a.org/x", "HTTP://example.org/es/1?x", "x://sub.example.org/en/1", "http://notexample.org/en/1", "http://com/fr/", "http://a.com/de/x#y", "http://a.com:80/de/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, urls[4]])], "page_id long, url string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
    assert len(got) == 12 and got[0] == got[2] == ("", "", None, "allow") and got[3] == ("a.org", "", None, "allow") and got[4] == got[11] == ("a.org", "/x", "org/", "allow")
    assert [got[i][2:] for i in (5, 6, 7, 8, 9, 10)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow")]
    assert urlfilter.judge(df, rules.limit(0)).where("verdict = 'allow' and rule is null").count() == 12


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, SF).toPandas(), docs.schema)
        assert kept.columns == docs.columns and kept.join(before, "doc_id", "left_anti").count() == 0, name
    texts = [r.text for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_near_dedup_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(300))
    found = [(1, long, "b"), (1, long, "a"), (1, "quite another text about the sea and its islands in winter", "c"), (2, long, "d"), (None, "one more text on stones, rivers and old bridges of the north", "e"), (None, None, "f"), (3, "", "g")]
    docs = spark.createDataFrame(found, "doc_id long, text string, k_id string").withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
    got = corpus_pipeline.dedup_near(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.k_id for r in got.collect()) == ["a", "c", "e", "f"]
    assert corpus_pipeline.dedup_near(spark, docs.limit(0), SF).count() == 0


def brute_kept(texts, jaccard=0.8, size=5):
    """The least id of each component of the pairs with at least that Jaccard similarity."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= jaccard:
                gone, stays = max(label[a], label[b]), min(label[a], label[b])
                label = {i: stays if v == gone else v for i, v in label.items()}
    return sorted({*label.values()})


def edited(rng, words, scattered, changed):
    """A copy in which one block of that many words, or each of so many words 5 or more apart, is new."""
    at = rng.choice(len(words) // 5, changed, replace=False) * 5 if scattered else rng.integers(0, len(words) - changed) + np.arange(changed)
    fresh = {int(k): f"n{rng.integers(1 << 40)}" for k in at}
    return " ".join(fresh.get(k, w) for k, w in enumerate(words))


def test_near_dedup_keeps_pairs_below_the_similarity(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for g in range(120):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        scattered = g % 2 == 0
        changed = int(rng.integers(3, 16)) if scattered else int(rng.integers(8, 70))
        texts |= {2 * g: " ".join(words), 2 * g + 1: edited(rng, words, scattered, changed)}
    want = brute_kept(texts)
    assert 130 < len(want) < 230
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF)
    # Whatever the brute force keeps stays.
    assert set(want) <= {r.doc_id for r in got.collect()}


def test_near_dedup_finds_block_edits(spark):
    rng = np.random.default_rng(13)
    texts = {}
    for g in range(150):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        changed = int(rng.integers(18, 29)) if g % 3 else int(rng.integers(29, 40))
        other = [edited(rng, words, False, changed), " ".join(words[changed:]), " ".join([*words, *(f"n{x}" for x in rng.integers(0, 1 << 40, changed))])][g // 3 % 3]
        texts |= {2 * g: " ".join(words), 2 * g + 1: other}
    want = brute_kept(texts)
    assert 150 < len(want) < 250
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_exact_forest():
    rng = np.random.default_rng(12)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
        for _ in range(12):
            sets.append(np.unique(np.concatenate((base[rng.random(40) < 0.9], rng.integers(0, 1 << 60, int(rng.integers(0, 4)), dtype=np.uint64)))))
    sets += [np.array([1, 2, 3, 4], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 6], np.uint64), np.array([], np.uint64)]
    near = {(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) / max(len(np.union1d(sets[a], sets[b])), 1) >= 0.8}

    def labels(edges):
        label = list(range(len(sets)))
        for a, b in edges:
            gone, stays = max(label[a], label[b]), min(label[a], label[b])
            label = [stays if v == gone else v for v in label]
        return label

    found = similar.exact_forest(sets, 0.8)
    assert all((max(e), min(e)) in near for e in found)
    assert labels(found) == labels(near) and len(found) == len(sets) - len(set(labels(near)))
