"""Links of texts by the exact Jaccard similarity of their sets of word shingles.

Candidates are texts that share a MinHash band, and pairs that are given (SimHash links). A bucket holds the classes of
equal sets that share a band; it is never turned into pairs. First each large component of candidates is compared with its
most central class, twice, which joins a group of near copies in time linear in its size. Only buckets that then hold
classes with different labels are compared, label against label, in tiles of two blocks, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.shared import BROADCAST, checkpoint, few, join_spread, map_batches, rows, runs, utf8
from helixframe.llm.shingles import majority, shingles

#: MinHash bands and the minima of each: of pairs at a Jaccard similarity of 0.8 all but one of 350 share a band.
BANDS, BAND_ROWS = 32, 8
#: Classes and shingles of a block, of which a tile compares two; classes of a component that make it a large one.
BLOCK, BLOCK_SHINGLES, LARGE = 2048, 1 << 20, 256
#: Central classes that a large component is compared with.
ROUNDS = 2
_RANDOM = np.random.default_rng(42)
_XORS = _RANDOM.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)
_ODDS = _RANDOM.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(1)
_JOIN = _RANDOM.integers(0, 1 << 63, BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_digests(text: bytes, size: int) -> bytes:
    """XXH64 (seed 42) of all shingles of the lower-cased text, 8 bytes each, the highest first."""
    digest = xxhash.xxh64_digest
    return b"".join([digest(s, 42) for s in shingles(text.lower().split(), size)])


def shingle_set(digests: bytes) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64))


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each MinHash function over a set."""
    least, x = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[at : at + 1024] ^ _XORS) * _ODDS).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A long for each band, which the band's number and its minima determine; ``least`` is rows x minima."""
    h = (least.reshape(len(least), BANDS, BAND_ROWS).astype(np.uint64) * _JOIN).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _JOIN[0]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _same(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def prints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, same, many, bands`` for every row: the SimHash, 16 bytes that equal sets share, the set's size and band keys.

    Null texts are empty; texts without a word have an empty set and no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1000):
            fps, same, many, least = [], [], [], []
            for x in batch.column(1):
                digests = shingle_digests(x.as_py(), size)
                fps.append(int.from_bytes(majority(iter((digests,)), 8), "big", signed=True))
                found = shingle_set(digests)
                same.append(_same(found))
                many.append(len(found))
                least.append(minima(found))
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(BANDS * (n > 0) for n in many)]), pa.int32()), pa.array(band_keys(np.stack(least))[np.array(many) > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(same, pa.binary()), pa.array(many, pa.int64()), keys], ["id", "fp", "same", "many", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text")), run, f"id {kind}, fp bigint, same binary, many bigint, bands array<bigint>")


def sets_of(members: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``node, shingles`` (sorted longs) of the classes ``members`` (``node, first, same``), from the texts of ``docs`` (``id, text``)."""
    keyed = members.select("node", "same", F.col("first").alias("m_id"), F.xxhash64("first").alias("m_h"))
    texts = docs.select("id", "text", F.xxhash64("id").alias("d_h"))
    marks = keyed.select(F.col("m_h").alias("d_h")).distinct()
    if few(members, BROADCAST):
        # Then only the members' texts move.
        texts = texts.join(F.broadcast(marks), "d_h", "left_semi")
    texts = texts.withColumn("text", utf8(F.col("text")))
    held = texts.join(keyed, (F.col("m_h") == F.col("d_h")) & F.col("m_id").eqNullSafe(F.col("id"))).select("node", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 500):
            nodes, sets = [], []
            for node, same, text in zip(batch.column("node").to_pylist(), batch.column("same"), batch.column("text")):
                found = shingle_set(shingle_digests(text.as_py(), size))
                # Rows of one id can have other texts than the class's.
                if _same(found) == same.as_py():
                    nodes.append(node)
                    sets.append(found.view(np.int64))
            if nodes:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], ["node", "shingles"])

    made = map_batches(held, run, "node bigint, shingles array<bigint>")
    # Repeated rows of one id and text give the same set.
    return made.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def exact_forest(sets: list[np.ndarray], jaccard: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (row numbers) of a spanning forest of the pairs whose sets have at least that Jaccard similarity.

    Rows with the same one of ``labels`` count as connected already.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    ends = np.cumsum(sizes)
    known, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, left, edges = np.zeros(len(known), bool), np.ones(n, bool), []
    labels = np.arange(n) if labels is None else labels
    # Elements of the rows that nothing has reached, and how many rows these were.
    live, owner, held = codes, np.repeat(np.arange(n), sizes), n

    def reach(found: list[int]) -> list[int]:
        more = np.flatnonzero(left & np.isin(labels, labels[found]))
        left[more] = False
        return more.tolist()

    for seed in range(n):
        queue = reach([seed]) if left[seed] else []
        while queue:
            i = queue.pop()
            rest = int(left.sum())
            if not rest:
                return edges
            if rest * 2 <= held:
                keep = left[owner]
                live, owner, held = live[keep], owner[keep], rest
            mine = codes[ends[i] - sizes[i] : ends[i]]
            mark[mine] = True
            shared = np.bincount(owner[mark[live]], minlength=n)
            mark[mine] = False
            found = np.flatnonzero(left & (shared >= jaccard * np.maximum(sizes + sizes[i] - shared, 1))).tolist()
            edges += [(i, j) for j in found]
            queue += reach(found)
    return edges


def central_links(members: DataFrame, sets: DataFrame, jaccard: float) -> tuple[DataFrame, DataFrame]:
    """Labels ``node, label`` of the classes of large components that a central class is linked to, and these links ``a, b``.

    ``members`` has ``node, root, central``. A component is dealt to parts of about ``LARGE`` classes, and each part is given
    its central class, so that no part grows with its component.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > LARGE)
    large = join_spread(members, sizes, ["root"], "size").withColumn("salts", F.ceil(F.col("size") / LARGE).cast("int"))
    held = checkpoint(large.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).select("root", "salt", "salts", "node", "central", "shingles").repartition("root", "salt"))
    labels = held.select("node", F.lit(None).cast("bigint").alias("label")).where("false")
    for _ in range(ROUNDS):
        free = held.join(labels, "node", "left_anti")
        first = free.groupBy("root", "salts").agg(F.max(F.struct("central", "node")).alias("m")).select("root", "salts", F.col("m.node").alias("node"))
        leader = first.join(sets, "node").select("root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("node").alias("label"), F.col("shingles").alias("l_shingles"))
        both = free.join(leader, ["root", "salt"])
        shared = F.size(F.array_intersect("shingles", "l_shingles"))
        near = shared >= jaccard * (F.size("shingles") + F.size("l_shingles") - shared)
        labels = checkpoint(labels.union(both.where(near).select("node", "label")))
    return labels, labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def bucket_links(buckets: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Edges ``a, b`` that connect all links between classes of different labels in a bucket (``key, node, label, many``).

    Only buckets with two labels or more move. A large bucket is cut to blocks, those of its most frequent label apart; each
    pair of blocks is a tile, except two blocks of that label.
    """
    kinds = buckets.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("many").alias("many"))
    mixed = kinds.groupBy("key").agg(F.max(F.struct("n", "label", "many")).alias("main"), F.sum("n").alias("n"), F.sum("many").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n, many: F.greatest(F.ceil(n / BLOCK), F.ceil(many / BLOCK_SHINGLES), F.lit(1)).cast("int")
    whole = blocks(F.col("n"), F.col("all")) == 1
    plan = mixed.select("key", "n", F.col("main.label").alias("main"), F.when(whole, 0).otherwise(blocks(F.col("main.n"), F.col("main.many"))).alias("xs"), F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("main.n"), F.col("all") - F.col("main.many"))).alias("ys"))
    dealt = join_spread(buckets.select("key", "node", "label"), plan, ["key"], "n")
    # Blocks 0 to ys - 1 are of other labels, those from ys on of the main one; a small bucket is one block.
    of_main = (F.col("label") == F.col("main")) & (F.col("xs") > 0)
    own = F.pmod(F.xxhash64("node"), F.when(of_main, F.col("xs")).otherwise(F.col("ys"))).cast("int") + F.when(of_main, F.col("ys")).otherwise(0)
    against = F.sequence(F.lit(0), F.when(of_main, F.col("ys")).otherwise(F.col("xs") + F.col("ys")) - 1)
    tiles = dealt.select("key", "node", "label", own.alias("own"), F.explode(against).alias("t")).select("key", "node", "label", F.least("own", "t").alias("x"), F.greatest("own", "t").alias("y"))
    ready = tiles.join(sets, "node").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "x", "y"]):
            nodes, found = group.column("node").to_numpy(), group.column("shingles").combine_chunks()
            ends, flat = found.offsets.to_numpy(), found.values.to_numpy()
            edges = exact_forest([flat[a:b] for a, b in zip(ends, ends[1:])], jaccard, group.column("label").to_numpy())
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[[e[k] for e in edges]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_batches(ready, run, "a bigint, b bigint")


def exact_links(candidates: DataFrame, classes: DataFrame, docs: DataFrame, size: int, jaccard: float) -> DataFrame:
    """Edges ``a, b`` that connect all classes of at least that Jaccard similarity that share a band or are ``candidates`` (``a, b``).

    ``classes`` has ``node, first, same, many, bands``; ``docs`` has ``id, text``.
    """
    pair = F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))
    given = candidates.where("a <> b").select(pair.alias("key"), F.explode(F.array("a", "b")).alias("node")).distinct()
    keyed = classes.select(F.explode("bands").alias("key"), "node")
    # A key of one class alone is most keys, so only the others meet their rows again.
    shared = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    ours = join_spread(keyed, shared, ["key"], "n")
    both = checkpoint(ours.unionByName(given.groupBy("key").agg(F.min("node").alias("least")).join(given, "key").select("key", "node", F.lit(2).cast("bigint").alias("n"), "least")))
    roots = components(both.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    rooted = both.groupBy("node").agg(F.sum("n").alias("central")).join(roots, "node", "left").select("node", "central", F.coalesce("root", "node").alias("root"))
    members = checkpoint(rooted.join(classes.select("node", "first", "same", "many"), "node"))
    sets = checkpoint(sets_of(members, docs, size))
    labels, near = central_links(members.select("node", "root", "central"), sets, jaccard)
    named = members.select("node", "many").join(labels, "node", "left").select("node", "many", F.coalesce("label", "node").alias("label"))
    return near.union(bucket_links(both.select("key", "node").join(named, "node"), sets, jaccard))
