"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import checkpoint, map_batches


def _forest(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Replace each window of at most ``most`` edges by stars with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, root(x)) for x in list(parent)]
        kept = [(x, r) for x, r in found if x != r]
        parent.clear()
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([r for _, r in kept], pa.int64())})

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > most:
            yield stars()
    if parent:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a``, ``b``) that isn't the smallest of its component.

    No component is ever gathered in one place: a hub's rows meet only in aggregates that combine on the map side and in
    joins that AQE can split. Self-loops, repeated edges and an empty table are allowed.
    """
    now = checkpoint(map_batches(edges.select("a", "b").where("a <> b"), _forest, "a bigint, b bigint").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark.n == 0 or (mark.n, mark.x) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = (mark.n, mark.x)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = checkpoint(small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
