"""URL filters: a blocked Bloom filter of listed URLs passes possible hits on to an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import checkpoint, join_spread, map_batches
from helixframe.llm.shared import rows as cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of 64 bits of a block, bits set for a key, bits a key is given, and the most blocks: 8 MB, so it may be broadcast.
WORDS, PROBES, PER_KEY, MOST = 8, 6, 12, 1 << 17


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def probe(key: int, blocks: int) -> tuple[int, int]:
    """A key's block and, over the block's 512 bits, its mask."""
    block, mask = (key >> 32) % blocks, 0
    for i in range(PROBES):
        mask |= 1 << ((key * (2 * i + 1) + (key >> 7 * i)) & 511)
    return block, mask


def bloom(rules: DataFrame) -> np.ndarray:
    """Blocks of the rules' keys (``host`` and ``path`` joined). Built by an aggregate of masks; at most 8 MB come back."""
    n = rules.count()
    blocks = min(MOST, max(1, -(-n * PER_KEY // (64 * WORDS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            for key in batch.column("key").to_pylist():
                b, mask = probe(key & 0xFFFFFFFFFFFFFFFF, blocks)
                seen[b] = seen.get(b, 0) | mask
            words = [(b * WORDS + w, int(np.uint64(mask >> 64 * w & 0xFFFFFFFFFFFFFFFF).astype(np.int64))) for b, mask in seen.items() for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in words], pa.int64()) for i in (0, 1)], ["word", "bits"])

    found = map_batches(rules.select(F.xxhash64(F.concat("host", "path")).alias("key")), run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(blocks * WORDS, np.uint64)
    for r in found.where("bits <> 0").toLocalIterator():
        out[r.word] = np.int64(r.bits).astype(np.uint64)
    return out


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[tuple[str, str]]:
    """All rules that could fit: the host and its parent domains, with the path's prefixes of the rules' lengths."""
    at = 0
    while True:
        for n in lengths:
            if n > len(path):
                break
            yield host[at:], path[:n]
        if (at := host.find(".", at) + 1) == 0:
            return


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row: that of the longest rule that fits, else ``default``.

    ``rules`` has ``host, path, verdict``; a rule fits its host and all subdomains if the path starts with the rule's. Of
    rules with one host and path a block wins. URLs that are null or without ``://`` have an empty host and path, which only
    a rule of empty host and path fits. Repeated rows each keep a row; an empty table gives an empty result; without rules all
    rows get the default.
    """
    listed = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    words = bloom(listed)
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())  # at most the longest path's length
    held = pages.sparkSession.sparkContext.broadcast(words)
    split = pages.select(F.monotonically_increasing_id().alias("nth"), F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = held.value.reshape(-1, WORDS)
        table: dict[int, int] = {}
        for batch in cut(batches):
            out = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                hits = []
                for h, p in candidates(host, path, lengths):
                    b, mask = probe(xxhash.xxh64_intdigest((h + p).encode(), 42), len(raw))
                    if (block := table.get(b)) is None:
                        block = int.from_bytes(raw[b].astype("<u8").tobytes(), "little")
                        if len(table) < 65536:
                            table[b] = block
                    if block & mask == mask:
                        hits.append({"h": h, "p": p})
                out.append(hits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.struct([("h", pa.string()), ("p", pa.string())])))], [*batch.schema.names, "hits"])

    kind = split.schema["page_id"].dataType.simpleString()
    # Written once, so that a page's number stays the same when a lost task is repeated.
    passed = checkpoint(map_batches(split, run, f"nth bigint, page_id {kind}, host string, path string, hits array<struct<h:string,p:string>>"))
    hits = passed.select("nth", F.explode("hits").alias("hit")).select("nth", "hit.h", "hit.p")
    exact = listed.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("verdict").alias("verdict"))
    known = hits.groupBy("h", "p").agg(F.count("*").alias("n")).join(exact, ["h", "p"])
    rule = F.concat("h", "p")
    best = F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("verdict").alias("verdict")))
    judged = join_spread(hits, known, ["h", "p"], "n").groupBy("nth").agg(best.alias("best"))
    # A page is one row on either side; those without a rule are not gathered.
    return passed.drop("hits").join(judged, "nth", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
