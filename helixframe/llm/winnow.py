"""Document fingerprints by winnowing: rolling k-gram hashes, the rightmost minimum of each window, positions kept."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import map_batches, parts, rows

#: Code points of a gram, and grams of a window: any passage of K + W - 1 code points that two texts share is found.
K, W = 12, 21
_BASE = 0x9E3779B97F4A7C15


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(text: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all grams: the polynomial rolling hash modulo 2**64, joined from doubled lengths, then mixed."""
    joined, size, out, done = text.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = joined
            else:
                n = len(joined) - done
                out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + joined[done : done + n]
            done += size
        if done == k:
            break
        joined = joined[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + joined[size:]
        size *= 2
    out = out[: len(text) - k + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint64)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected grams, ascending. A text under ``k`` code points is one gram; empty: none."""
    if not 1 <= w <= 255:
        raise ValueError("w must be from 1 to 255, so that a step fits a byte")
    p = points(text)
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h = gram_hashes(p, min(k, len(p)))
    # The lower half holds the position from the right, so that of equal hashes the rightmost is the least.
    least = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    size, want = 1, min(w, len(h))
    while 2 * size <= want:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if want > size:
        least = np.minimum(least[: len(least) - (want - size)], least[want - size :])
    picked = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (np.uint64(0xFFFFFFFF) - (picked & np.uint64(0xFFFFFFFF))).astype(np.int64), (picked >> np.uint64(32)).astype(np.uint32)


def encode(positions: np.ndarray, hashes: np.ndarray) -> str:
    """10 hex digits a gram: its hash, and its distance from the last gram's position (at most W, so one byte)."""
    out = np.zeros((len(hashes), 5), np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(positions, prepend=0)
    return out.tobytes().hex()


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 4].astype(np.int64)), np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of selected hashes; of two empty ones 1."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 1.0 if not len(a) and not len(b) else shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """All rows with ``fingerprint``, read back by ``decode``: no shuffle. Null texts count as empty, which give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            prints = [encode(*winnow(x.as_py() or "", k, w)) for x in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(prints, pa.string())], [id_col, "fingerprint"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``grp, id, text, extra``: contiguous id ranges, each to be sorted in one partition, with the following range's first row as an extra.

    Range bounds are quantiles of the ids, at most four for each shuffle partition, so what the driver holds is bounded by
    the number of partitions and never by the documents. The last range's extra is the first row of all.
    """
    n = 4 * parts(docs)
    ids = docs.select(F.col(id_col).alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n).alias("q")).first().q or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    group = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("id"))))
    heads = sorted(ids.groupBy(group.alias("grp")).agg(F.min("id").alias("id")).collect())
    spark = docs.sparkSession
    back = [(h.id, heads[i - 1].grp, i == 0) for i, h in enumerate(heads)]
    before = F.broadcast(spark.createDataFrame(back, "h_id bigint, h_grp int, wraps boolean").coalesce(1))
    full = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("grp", group)
    extra = full.join(before, F.col("id").eqNullSafe(F.col("h_id"))).select(F.col("h_grp").alias("grp"), "id", "text", F.lit(True).alias("extra"))
    return full.select("grp", "id", "text", F.lit(False).alias("extra")).union(extra).repartition(n, "grp").sortWithinPartitions("grp", "extra", F.col("id").asc_nulls_first(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and their likeness, and its likeness to the next row's.

    The edited text has the last floor(n / 2) of n code points replaced by the first as many of the next text in ascending
    id, or by all of it; after the last row comes the first. Null texts count as empty; a null id comes first; rows with
    equal ids follow each other by text; a single row follows itself; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        last = None
        for batch in rows(batches, 500):
            out = []
            for grp, i, text, extra in zip(*(batch.column(c).to_pylist() for c in ("grp", "id", "text", "extra"))):
                marks = winnow(text, k, w)
                if last is not None and last[0] == grp:
                    _, of, before, own = last
                    half = len(before) // 2
                    edited = before[: len(before) - half] + text[:half]
                    changed = winnow(edited, k, w)
                    out.append((of, len(before), hashlib.sha256(edited.encode()).hexdigest(), encode(*own), encode(*changed), likeness(own[1], changed[1]), likeness(own[1], marks[1])))
                last = None if extra else (grp, i, text, marks)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return map_batches(in_order(docs, id_col, text_col), run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
