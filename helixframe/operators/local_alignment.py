"""Smith-Waterman local alignment, an Arrow-batched function: it has no form as a column expression."""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the matrices that are computed at once.
CELLS = 1 << 20
SCHEMA = "score int, query_start int, query_end int, reference_start int, reference_end int, cigar string"


def align(query: str, reference: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[int, int, int, int, int, str]:
    """Best local alignment: the first maximum in row order; diagonal before up before left. Linear gap costs.

    A row's left-going scores are a running maximum of ``score - j * gap``, so each row is a few vector operations. Of the m
    rows only each sqrt(m)-th is kept; the way back computes the rows between two of them again, so that memory is n * sqrt(m).
    """
    m, n = len(query or ""), len(reference or "")
    if not m or not n:
        return 0, 0, 0, 0, 0, ""
    q, r = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(reference.encode("utf-32-le"), np.uint32)
    ramp = np.arange(n + 1, dtype=np.int32) * gap

    def after(above: np.ndarray, i: int) -> np.ndarray:
        """Row ``i`` from the one above it."""
        row = np.maximum(above[:-1] + np.where(r == q[i - 1], match, mismatch), above[1:] + gap)
        return (np.maximum.accumulate(np.concatenate(([0], np.maximum(row, 0))) - ramp) + ramp).astype(np.int32)

    every = math.isqrt(m - 1) + 1
    row, kept, best, end_i, end_j = np.zeros(n + 1, np.int32), [], 0, 0, 0
    for i in range(m + 1):
        if i:
            row = after(row, i)
            if row.max() > best:
                best, end_i, end_j = int(row.max()), i, int(row.argmax())
        if i % every == 0:
            kept.append(row)
    i, j, ops, first, rows = end_i, end_j, [], m + 1, []
    while i and j:
        if i - 1 < first:  # the rows from the last kept one above this
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for k in range(first + 1, i + 1):
                rows.append(after(rows[-1], k))
        here, above = rows[i - first], rows[i - 1 - first]
        if here[j] <= 0:
            break
        if here[j] == above[j - 1] + (match if q[i - 1] == r[j - 1] else mismatch):
            op, i, j = "M", i - 1, j - 1
        elif here[j] == above[j] + gap:
            op, i = "I", i - 1
        else:
            op, j = "D", j - 1
        if ops and ops[-1][1] == op:
            ops[-1][0] += 1
        else:
            ops.append([1, op])
    return best, i, end_i, j, end_j, "".join(f"{c}{o}" for c, o in reversed(ops))


def align_many(queries: list[str], references: list[str], match: int = 2, mismatch: int = -1, gap: int = -2) -> list[tuple[int, int, int, int, int, str]]:
    """``align`` of each pair. Pairs of similar size are padded and computed together, ``CELLS`` cells at once; larger ones alone."""
    out: list = [None] * len(queries)
    small = []
    for i, (q, r) in enumerate(zip(queries, references)):
        cells = (len(q or "") + 1) * (len(r or "") + 1)
        if gap > 0 or cells > CELLS // 16 or cells <= len(q or "") + len(r or "") + 1:
            out[i] = align(q, r, match, mismatch, gap)
        else:
            small.append(i)
    small.sort(key=lambda i: (len(queries[i]), len(references[i])))
    at = 0
    while at < len(small):
        group, m, n = [], 0, 0
        while at < len(small):
            q, r = queries[small[at]], references[small[at]]
            if (len(group) + 1) * (max(m, len(q)) + 1) * (max(n, len(r)) + 1) > CELLS:
                break
            group.append(small[at])
            m, n, at = max(m, len(q)), max(n, len(r)), at + 1
        for i, found in zip(group, _align_group([queries[i] for i in group], [references[i] for i in group], m, n, match, mismatch, gap)):
            out[i] = found
    return out


def _align_group(queries: list[str], references: list[str], m: int, n: int, match: int, mismatch: int, gap: int) -> list[tuple[int, int, int, int, int, str]]:
    """As ``align``, each step for all pairs; what pads a text equals nothing, and cells beyond a text's end count as -1, below any score."""
    size = len(queries)
    codes = lambda texts, width, fill: np.frombuffer("".join(t.ljust(width, fill) for t in texts).encode("utf-32-le"), np.uint32).reshape(size, width)
    q, r = codes(queries, m, "\0"), codes(references, n, "\0")
    q_size, r_size = np.array([len(t) for t in queries]), np.array([len(t) for t in references])
    ramp = np.arange(n + 1, dtype=np.int32) * gap
    beyond = np.arange(n + 1) > r_size[:, None]
    rows = np.zeros((m + 1, size, n + 1), np.int32)
    best, end_i, end_j = np.zeros(size, np.int32), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for i in range(1, m + 1):
        above, row = rows[i - 1], rows[i]
        row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(r == q[:, i - 1 : i], match, mismatch), above[:, 1:] + gap), 0)
        row[:] = np.maximum.accumulate(row - ramp, axis=1) + ramp
        real = np.where(beyond, -1, row)
        top = real.max(axis=1)
        better = (top > best) & (i <= q_size)
        best[better], end_i[better], end_j[better] = top[better], i, real.argmax(axis=1)[better]
    i, j, pairs = end_i.copy(), end_j.copy(), np.arange(size)
    ops = np.zeros((m + n, size), "S1")
    for step in range(m + n):
        pairs = pairs[(i[pairs] > 0) & (j[pairs] > 0)]
        pairs = pairs[rows[i[pairs], pairs, j[pairs]] > 0]
        if not len(pairs):
            break
        x, y = i[pairs], j[pairs]
        here = rows[x, pairs, y]
        diagonal = here == rows[x - 1, pairs, y - 1] + np.where(q[pairs, x - 1] == r[pairs, y - 1], match, mismatch)
        up = ~diagonal & (here == rows[x - 1, pairs, y] + gap)
        ops[step, pairs] = np.where(diagonal, b"M", np.where(up, b"I", b"D"))
        i[pairs] -= diagonal | up
        j[pairs] -= ~up
    texts = ["".join(f"{len(list(g))}{c}" for c, g in groupby(o.tobytes().rstrip(b"\0").decode()[::-1])) for o in np.ascontiguousarray(ops.T)]
    return list(zip(best.tolist(), i.tolist(), end_i.tolist(), j.tolist(), end_j.tolist(), texts))


def smith_waterman(query: Column, reference: Column, match: int = 2, mismatch: int = -1, gap: int = -2) -> Column:
    """Struct of score, half-open spans and CIGAR."""

    @F.pandas_udf(SCHEMA)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_many(list(a), list(b), match, mismatch, gap), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run(query, reference)
