"""K-mer spectra and minimizers of ``id, seq`` tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import kmer

#: Minimizers of a batch that Python returns.
_MOST = 100_000
#: Characters of the sequences that are hashed at once.
_CHARS = 500_000


def spectrum(reads: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Count of each k-mer; partial counts are made before the shuffle."""
    return reads.select(*(by or []), F.explode(kmer.kmers(F.col("seq"), k)).alias("kmer")).groupBy(*(by or []), "kmer").agg(F.count("*").alias("n"))


def _fnv_minima(seqs: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The read's number, position, hash and letters of each minimizer of some sequences, which are laid end to end.

    Behind each sequence come as many zeros as keep its windows from the next one; a k-mer with one of them, or with any other
    letter than A, C, G, T, is void.
    """
    pad = k + w
    data = np.frombuffer("".join(s + "\0" * pad for s in seqs).encode("utf-32-le"), np.uint32)
    codes = np.where(data < 128, data, 0).astype(np.uint8)
    sizes = np.array([len(s) for s in seqs], np.int64)
    firsts = np.cumsum(sizes + pad) - sizes - pad
    n = len(codes) - k + 1
    bad = np.concatenate(([0], np.cumsum(~np.isin(codes, np.frombuffer(b"ACGT", np.uint8)), dtype=np.int32)))
    void = bad[k:] != bad[:-k]
    hashes = np.full(n, kmer.FNV_HIGH << 32 | kmer.FNV_LOW, np.uint64)
    for j in range(k):
        hashes ^= codes[j : j + n]
        hashes *= np.uint64(kmer.FNV_PRIME)
    hashes[void] = ~np.uint64(0)
    n -= w - 1
    best, at, none = hashes[:n].copy(), np.zeros(n, np.int32), void[:n].copy()
    for j in range(1, w):
        here = hashes[j : j + n]
        less = (here < best) | (none & ~void[j : j + n])
        np.copyto(best, here, where=less)
        at[less] = j
        none[less] = False
    read = np.repeat(np.arange(len(seqs), dtype=np.int32), sizes + pad)[:n]
    start = np.arange(n) - firsts[read]
    kept = np.flatnonzero(~none & (start <= np.maximum(sizes - k + 1 - w, 0)[read]))
    place = kept + at[kept]
    # Positions never go back, so a minimizer's repeats are neighbours; a place belongs to one read only.
    new = np.ones(len(kept), bool)
    new[1:] = place[1:] != place[:-1]
    kept, place = kept[new], place[new]
    letters = codes[place[:, None] + np.arange(k)]
    return read[kept], place - firsts[read[kept]], best[kept], letters


def _fnv(reads: DataFrame, k: int, w: int, schema: str, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """``id, position`` and columns of the hashes and letters of minimizers; about ``_CHARS`` characters are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(ids: list[int], seqs: list[str]) -> Iterator[pa.RecordBatch]:
            read, position, hashes, letters = _fnv_minima(seqs, k, w)
            held = batch.column(0).take(pa.array(ids)).take(pa.array(read))
            whole = pa.RecordBatch.from_arrays([held, pa.array(position, pa.int64()), *columns(hashes, letters)], names)
            for at in range(0, len(whole), _MOST):
                yield whole.slice(at, _MOST)

        for batch in batches:
            ids, seqs, size = [], [], 0
            for i, seq in enumerate(batch.column(1)):
                ids.append(i)
                seqs.append(seq.as_py())
                size += len(seqs[-1])
                if size > _CHARS:
                    yield from found(ids, seqs)
                    ids, seqs, size = [], [], 0
            if seqs:
                yield from found(ids, seqs)

    names = ["id", "position", *(c.split()[0] for c in schema.split(", "))]
    kept = reads.select("id", "seq").where(F.length("seq") >= k if k > 0 and w > 0 else F.lit(False))
    return kept.mapInArrow(run, f"id {reads.schema['id'].dataType.simpleString()}, position bigint, {schema}")


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """``id, position, hi, lo``: the least hash of each window of ``w`` k-mers, leftmost of equal ones, repeats in a row once.

    Fewer than ``w`` k-mers make one window; windows without a valid k-mer give nothing. A read stays in its row, many reads
    are hashed at once as arrays, and there is no shuffle.
    """
    halves = lambda h, letters: [pa.array((h >> np.uint64(32)).astype(np.int64)), pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64))]
    return _fnv(reads, k, w, "hi bigint, lo bigint", halves)


def minimizer_kmers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """``id, position, kmer``: the texts of ``minimizers``, cut out of the arrays that are hashed."""

    def texts(hashes: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
        ends = pa.py_buffer(np.arange(0, (len(letters) + 1) * k, k, dtype=np.int32)[: len(letters) + 1])
        return [pa.StringArray.from_buffers(len(letters), ends, pa.py_buffer(letters.tobytes()))]

    return _fnv(reads, k, w, "kmer string", texts)


def nthash_minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """``id, position, hash`` by canonical ntHash over full windows only; unsigned order. N hashes as 0.

    Arrays of a whole read are hashed at once; a batch holds about ``_MOST`` minimizers.
    """
    seeds = np.zeros((2, 128), np.uint64)
    for base, other in zip("ACGT", "TGCA"):
        seeds[0, ord(base)], seeds[1, ord(base)] = kmer.NT_SEEDS[base], kmer.NT_SEEDS[other]

    def rotl(x: np.ndarray, by: int) -> np.ndarray:
        by %= 64
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x

    def least(seq: str) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
        ahead, back = seeds[:, np.where(codes < 128, codes, 0)]
        n = len(codes) - k + 1
        forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for j in range(k):
            forward ^= rotl(ahead[j : j + n], k - 1 - j)
            reverse ^= rotl(back[j : j + n], j)
        hashes = np.minimum(forward, reverse)
        n -= w - 1
        best, at = hashes[:n], np.arange(n)
        for j in range(1, w):
            less = hashes[j : j + n] < best
            best, at = np.where(less, hashes[j : j + n], best), np.where(less, np.arange(j, j + n), at)
        new = np.concatenate(([True], at[1:] != at[:-1]))
        return at[new], best[new].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, found = [], []

            def joined() -> pa.RecordBatch:
                ids = batch.column(0).take(pa.array(np.repeat(held, [len(x[0]) for x in found])))
                return pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(x)) for x in zip(*found)]], ["id", "position", "hash"])

            size = 0
            for i, seq in enumerate(batch.column(1)):
                held.append(i)
                found.append(least(seq.as_py()))
                size += len(found[-1][0])
                if size > _MOST:
                    yield joined()
                    held, found, size = [], [], 0
            if found:
                yield joined()

    kept = reads.select("id", "seq").where(F.length("seq") >= k + w - 1 if k > 0 and w > 0 else F.lit(False))
    return kept.mapInArrow(run, f"id {reads.schema['id'].dataType.simpleString()}, position bigint, hash bigint")


def sliding_min(rows: DataFrame, w: int, by: str, order: str, value: str) -> DataFrame:
    """``by, order, value, min_at``: minimum of each full window of ``w`` rows and where it is, leftmost of equal ones."""
    if w < 1:
        raise ValueError("the window needs a width")
    over = Window.partitionBy(by).orderBy(order)
    span = over.rowsBetween(-(w - 1), 0)
    out = rows.select(by, order, F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("at"))).over(span).alias("m"), F.row_number().over(over).alias("n_"))
    return out.where(F.col("n_") >= w).select(by, order, F.col("m.v").alias("value"), F.col("m.at").alias("min_at"))


def jaccard(spectrum: DataFrame, by: str) -> DataFrame:
    """``a, b, jaccard`` of the k-mer sets of each two groups that share one; ``spectrum`` has ``kmer`` and the group's column.

    A k-mer's groups are gathered as a set, of as many as there are groups, and pairs are counted from it.
    """
    sizes = spectrum.groupBy(by).agg(F.count("*").alias("n"))
    groups = spectrum.groupBy("kmer").agg(F.array_sort(F.collect_set(by)).alias("g"))
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = groups.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("both"))
    x, y = sizes.select(F.col(by).alias("a"), F.col("n").alias("x")), sizes.select(F.col(by).alias("b"), F.col("n").alias("y"))
    return both.join(x, "a").join(y, "b").select("a", "b", (F.col("both") / (F.col("x") + F.col("y") - F.col("both"))).alias("jaccard"))
