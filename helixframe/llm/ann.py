"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in double precision, heaps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import checkpoint, map_batches, parts

#: Queries of a block, which a task holds; queries and candidates of a tile.
BLOCK, TILE_QUERIES, TILE_ROWS = 16384, 512, 4096


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """int8 rows with a scale each, and the norms of rounded row and rounding error for the bound."""

    def __init__(self, x: np.ndarray):
        scale = np.abs(x).max(1, keepdims=True) / 127
        scale[scale == 0] = np.finfo(np.float64).tiny
        self.codes = np.rint(x / scale).astype(np.int8)
        self.scale = scale[:, 0]
        near = self.codes * scale
        self.norm, self.error = np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)

    def take(self, part: slice) -> Quantised:
        out = object.__new__(Quantised)
        out.codes, out.scale, out.norm, out.error = self.codes[part], self.scale[part], self.norm[part], self.error[part]
        return out


def tile(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of all pairs and how far off each may be at most.

    Products of int8 codes are summed exactly: in single precision up to 1040 components, beyond in double. The bound is
    |q'||c - c'| + |q - q'||c| over rounded rows q', c', plus a slack for the rounding of the tile itself.
    """
    kind = np.float32 if q.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    sums = q.codes.astype(kind) @ c.codes.astype(kind).T
    about = sums * q.scale[:, None] * c.scale[None, :]
    own = c.norm + c.error
    off = q.norm[:, None] * c.error[None, :] + (q.error + 1e-12 * q.norm)[:, None] * own[None, :]
    return about, off * (1 + 1e-9)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed component by component."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


class Block:
    """A block of queries with a heap of the best candidates for each; candidates stream by."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.codes = ids, x, k, Quantised(x)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        codes = Quantised(x)
        for lo in range(0, len(self.ids), TILE_QUERIES):
            part = slice(lo, lo + TILE_QUERIES)
            about, off = tile(self.codes.take(part), codes)
            own = self.ids[part, None] == ids[None, :]
            low, high = np.where(own, -np.inf, about - off), np.where(own, -np.inf, about + off)
            heaps = self.heaps[part]
            least = np.array([h[0][0] if len(h) == self.k else -np.inf for h in heaps])
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
            a, b = np.nonzero((high >= least[:, None]) & ~own)
            for start in range(0, len(a), 1 << 18):
                aa, bb = a[start : start + (1 << 18)], b[start : start + (1 << 18)]
                for i, s, v in zip(aa.tolist(), exact(self.x[part][aa], x[bb]).tolist(), ids[bb].tolist()):
                    h = heaps[i]
                    if len(h) < self.k:
                        heappush(h, (s, -v))
                    elif (s, -v) > h[0]:
                        heappushpop(h, (s, -v))

    def found(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 512):
            out = [(int(i), -v, s) for i, h in zip(self.ids[at : at + 512], self.heaps[at : at + 512]) for s, v in h]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` nearest other rows by inner product; exact, so recall is 1.

    Queries are cut into blocks, candidates into groups; each task streams a group past a block in tiles. What moves is each
    candidate once for every block of queries and each query once for every group, in the components' own type. Ties go to the smaller id. Vectors that
    are null, zero, empty or hold null or non-finite components, and rows with a null id, take no part; only vectors of equal length are
    compared; rows with the query's own id are never its candidates; a query
    row that repeats is one query, a candidate row that repeats is found as often; fewer candidates than ``k`` are all returned.
    """
    clean = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    # Written once with a number that spreads rows of one id, which so stays the same when a lost task is repeated.
    rows = checkpoint(clean.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vec"), is_query.alias("asks"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")))
    n = rows.agg(F.count("*").alias("given"), F.count_if("asks").alias("asked")).first()
    blocks = max(1, math.ceil(n.asked / block))
    # A group fills a tile at least: what tasks return is a heap for each query and group.
    groups = max(1, min(math.ceil(2 * parts(vectors) / blocks), math.ceil(n.given / TILE_ROWS)))
    spread = lambda m: F.pmod("salt", F.lit(m)).cast("int")
    asked = rows.where("asks").dropDuplicates(["id", "vec"]).select("id", "vec", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    given = rows.select("id", "vec", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), spread(groups).alias("grp"))
    dealt = asked.unionByName(given).withColumn("dim", F.size("vec")).repartition(blocks * groups, "dim", "blk", "grp").sortWithinPartitions("dim", "blk", "grp", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, side, held, size, block_now = None, None, [], 0, None

        def settle() -> None:
            nonlocal held, size, block_now
            if held:
                ids = np.concatenate([i for i, _ in held])
                x = np.concatenate([v for _, v in held])
                if side == 0:
                    block_now = Block(ids, x, k)
                elif block_now is not None:
                    block_now.add(ids, x)
            held, size = [], 0

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "blk", "grp", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                task, kind = tuple(keys[a, :3]), int(keys[a, 3])
                if task != at or kind != side:
                    settle()
                    if task != at and block_now is not None:
                        yield from block_now.found()
                        block_now = None
                    at, side = task, kind
                part = batch.slice(a, b - a)
                ids, x = part.column("id").to_numpy(), part.column("vec").flatten().to_numpy().astype(np.float64).reshape(b - a, -1)
                for lo in range(0, b - a, TILE_ROWS):
                    held.append((ids[lo : lo + TILE_ROWS], x[lo : lo + TILE_ROWS]))
                    size += len(held[-1][0])
                    if side == 1 and size >= TILE_ROWS:
                        settle()
        settle()
        if block_now is not None:
            yield from block_now.found()

    best = map_batches(dealt, run, "query_id bigint, vec_id bigint, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
