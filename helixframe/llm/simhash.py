"""SimHash near-duplicates, whose candidates a pigeonring filter prunes.

A fingerprint is a ring of ``d + 1`` segments for ``d`` allowed differences. If two fingerprints differ in at most ``d``
bits, some segment starts a chain whose first ``l`` segments differ in at most ``l * d / (d + 1)`` bits for every ``l``:
the first segment is equal and the first two differ in one bit at most, so one half of the second is equal too. The key of
a bucket is the start, its segment and one half of the next; what meets in a bucket passes the longer chains in turn and
then the full Hamming check. Buckets above ``TILE`` rows are dealt to tiles of two blocks each, so that every pair still
meets. A tile yields the edges of a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm import similar
from helixframe.llm.components import components
from helixframe.llm.shingles import majority, shingles
from helixframe.llm.shared import checkpoint, join_spread, map_batches, rows, runs, utf8

#: Rows of a block; a tile compares two blocks.
TILE = 16384


def simhash(text: bytes, size: int = 3, seed: int = 42) -> bytes:
    """64-bit fingerprint, highest byte first, of the XXH64 values of the lower-cased text's word shingles."""
    digest = xxhash.xxh64_digest
    return majority((digest(s, seed) for s in shingles(text.lower().split(), size)), 8)


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` (a long) for every row; null texts are empty; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            fps = [int.from_bytes(simhash(x.as_py(), size), "big", signed=True) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text")), run, f"id {kind}, fp bigint")


def ring(distance: int) -> list[tuple[int, int]]:
    """Start and width of each of the ``distance + 1`` segments of 64 bits."""
    m = distance + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def bucket_keys(fp: Column, distance: int) -> Column:
    """Array of the bucket keys of a fingerprint: two for each start."""
    segments, keys = ring(distance), []
    for i, (at, width) in enumerate(segments):
        follow = segments[(i + 1) % len(segments)][1]
        head = follow // 2
        turned = _turned(fp, at)
        first = F.shiftrightunsigned(turned, 64 - width)
        for j, (skip, size) in enumerate(((0, head), (head, follow - head))):
            half = F.shiftrightunsigned(turned, 64 - width - skip - size).bitwiseAND(F.lit((1 << size) - 1))
            keys.append(F.lit((2 * i + j) << 57).cast("bigint") + F.shiftleft(first, 16) + half)
    return F.array(*keys)


def chain_masks(start: int, distance: int) -> list[tuple[np.uint64, int]]:
    """Mask over the turned fingerprint and budget of each chain from ``start``, from two segments to all."""
    segments, m, total, out = ring(distance), distance + 1, 0, []
    for length in range(1, m + 1):
        total += segments[(start + length - 1) % m][1]
        if length > 1:
            out.append((np.uint64(((1 << total) - 1) << (64 - total)), length * distance // m))
    return out


def forest(fps: np.ndarray, start: int, distance: int) -> list[tuple[int, int]]:
    """Edges (row numbers) of a spanning forest of the links among the fingerprints of one bucket."""
    n = len(fps)
    at = np.uint64(ring(distance)[start][0])
    turned = fps if not at else (fps << at) | (fps >> (np.uint64(64) - at))
    chains, label, edges = chain_masks(start, distance), np.arange(n), []
    step = max(1, (1 << 20) // n)
    for lo in range(0, n - 1, step):
        hi = min(n - 1, lo + step)
        x = turned[lo:hi, None] ^ turned[None, lo:]
        near = np.bitwise_count(x & chains[0][0]) <= chains[0][1]
        a, b = np.nonzero(np.triu(near, 1))
        diff = x[a, b]
        a, b = a + lo, b + lo
        for mask, budget in chains[1:]:
            keep = np.bitwise_count(diff & mask) <= budget
            a, b, diff = a[keep], b[keep], diff[keep]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        firsts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        for k, end in zip(firsts, [*firsts[1:], len(a)]):
            row, others = a[k], b[k:end]
            found, where = np.unique(label[others], return_index=True)
            other = found != label[row]
            if other.any():
                edges += [(int(row), int(others[w])) for w in where[other]]
                merged = np.concatenate((found, [label[row]]))
                label[np.isin(label, merged)] = merged.min()
    return edges


def links(classes: DataFrame, distance: int) -> DataFrame:
    """Edges ``a, b`` that connect all linked rows of ``classes`` (``node, fp``)."""
    keyed = classes.select("node", "fp", F.explode(bucket_keys(F.col("fp"), distance)).alias("key"))
    hot = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    whole, dealt = keyed.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)), None
    if not hot.isEmpty():
        blocks = F.ceil(F.col("n") / TILE).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda t: F.struct(F.least(own, t).alias("x"), F.greatest(own, t).alias("y")))
        dealt = join_spread(keyed, hot, ["key"], "n").select("node", "fp", "key", F.explode(tiles).alias("tile")).select("node", "fp", "key", "tile.x", "tile.y")
        whole = whole.join(hot, "key", "left_anti")
    dealt = whole.unionByName(dealt) if dealt else whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "x", "y"]):
            node = group.column("node").to_numpy()
            found = forest(group.column("fp").to_numpy().view(np.uint64), group.column("key")[0].as_py() >> 58, distance)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(node[[e[k] for e in found]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return map_batches(dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"), run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """``id, fp, component`` for every row: its fingerprint and the smallest id that it reaches by links.

    Fingerprints link at ``distance`` or fewer differing bits (1 to 31). With ``jaccard`` such a link is a candidate only, as is
    a MinHash band that two texts share (``similar``); a link's texts have at least that similarity of their sets of shingles
    of ``size`` words, counted exactly, and equal sets share a component.

    Texts that are null, empty or blank have the fingerprint zero and link like any other. Equal texts always share a
    component. Rows with the same id each keep their own row. A null id never names a component unless nothing else is
    reachable. An empty table gives an empty result; other columns are ignored.
    """
    if not 1 <= distance <= 31:
        raise ValueError("distance must be from 1 to 31")
    by = "fp" if jaccard is None else "same"
    each = checkpoint(fingerprints(docs, size, id_col, text_col) if jaccard is None else similar.prints(docs, size, id_col, text_col))
    more = [] if jaccard is None else [F.min("fp").alias("fp"), F.any_value("many").alias("many"), F.any_value("bands").alias("bands")]
    classes = checkpoint(each.groupBy(by).agg(F.min("id").alias("first"), F.count("*").alias("n"), *more).withColumn("node", F.monotonically_increasing_id()))
    found = links(classes, distance)
    if jaccard is not None:
        found = similar.exact_links(found, classes, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), size, jaccard)
    roots = components(found)
    rooted = checkpoint(classes.select("node", "first", by, "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size"))
    named = join_spread(rooted, least, ["root"], "size").select(by, "n", "component")
    return join_spread(each, checkpoint(named), [by], "n").select("id", "fp", "component")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of the long's 64 bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
