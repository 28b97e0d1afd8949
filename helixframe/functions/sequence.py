"""Sequence and quality functions as column expressions; all but the mean quality stay inside generated code or the JVM.

Sequences are strings of bases, qualities strings of ``chr(33 + Q)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# IUPAC complements, upper and lower case; U counts as T. W, S and N are their own.
COMPLEMENT_FROM = "ATGCatgcUuRYKMBVDHrykmbvdh"
COMPLEMENT_TO = "TACGtacgAaYRMKVBHDyrmkvbhd"
DNA = "ACGTNRYWSKMBDHVacgtnrywskmbdhv"
RNA = "ACGUNRYWSKMBDHVacgunrywskmbdhv"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; a lambda inside it would otherwise compute the value for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_char(seq: Column, char: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(char), F.lit("")))).cast("bigint")


def base_counts(seq: Column) -> Column:
    """Struct of the upper-case A, C, G and T counts."""
    return F.struct(*[count_char(seq, b).alias(b.lower()) for b in "ACGT"])


def gc_content(seq: Column) -> Column:
    """(G + C) / (A + C + G + T); 0 if there is none."""
    gc = count_char(seq, "G") + count_char(seq, "C")
    acgt = gc + count_char(seq, "A") + count_char(seq, "T")
    return F.when(acgt == 0, 0.0).otherwise(gc / F.nullif(acgt, F.lit(0)))


def complexity(seq: Column) -> Column:
    """Shannon entropy of A, C, G, T over the whole length, halved to 0..1; empty: 0."""
    n = F.length(seq)
    terms = [F.when(count_char(seq, b) > 0, -(count_char(seq, b) / n) * F.log2(count_char(seq, b) / n)).otherwise(0.0) for b in "ACGT"]
    return F.when(n == 0, 0.0).otherwise(sum(terms[1:], terms[0]) / 2)


def qualities(qual: Column) -> Column:
    """Array of the qualities."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


@F.arrow_udf(T.DoubleType())
def mean_quality_udf(qual: pa.Array) -> pa.Array:
    """From the batch's bytes and offsets at once: sums are differences of one running sum."""
    ends = np.frombuffer(qual.buffers()[1], np.int32)[qual.offset : qual.offset + len(qual) + 1].astype(np.int64)
    data = np.frombuffer(qual.buffers()[2] or b"", np.uint8)[: ends[-1]]
    n = np.diff(ends)
    upto = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
    means = (upto[ends[1:]] - upto[ends[:-1]] - 33 * n) / np.maximum(n, 1)
    return pa.array(means, pa.float64(), mask=qual.is_null().to_numpy(zero_copy_only=False))


def mean_quality(qual: Column) -> Column:
    """Mean quality; empty: 0. Qualities are ASCII, so Arrow's bytes are summed instead of an array of characters."""
    return mean_quality_udf(qual)


def passes_quality(qual: Column, least: float) -> Column:
    return mean_quality(qual) >= least


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def quality_features(seq: Column, qual: Column, length: int | None = None) -> Column:
    """What a quality model reads: bases as 0 to 1 in steps of a quarter (A, C, G, T, others), then bytes of the qualities by 93.

    Each half is padded with zeros to ``length``. Halves of different lengths, or longer ones, are errors.
    """
    codes = F.transform(F.split(F.translate(F.upper(seq), "ACGT", "0123"), ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(4)))
    base = F.transform(codes, lambda x: (F.when(x > 3, 4).otherwise(x) / 4).cast("float"))
    score = F.transform(F.split(qual, ""), lambda x: (F.ascii(x) / 93).cast("float"))

    def half(values: Column) -> Column:
        own = F.when(F.length(seq) == 0, F.array().cast("array<float>")).otherwise(values)
        return own if length is None else F.concat(own, F.array_repeat(F.lit(0.0).cast("float"), F.lit(length) - F.length(seq)))

    wrong = F.raise_error(F.lit("sequence and quality differ in length, or are too long")).cast("array<float>")
    fits = F.length(seq) == F.length(qual)
    return F.when(fits if length is None else fits & (F.length(seq) <= length), F.concat(half(base), half(score))).when(seq.isNull() | qual.isNull(), F.lit(None)).otherwise(wrong)


def count_invalid(seq: Column) -> Column:
    """Characters outside the DNA alphabet; U is one of them."""
    return F.length(F.regexp_replace(seq, f"[{DNA}]", "")).cast("bigint")


def is_valid_dna(seq: Column) -> Column:
    return seq.rlike(f"^[{DNA}]*$")


def is_valid_rna(seq: Column) -> Column:
    return seq.rlike(f"^[{RNA}]*$")


def meets_length(seq: Column, least: int, most: int) -> Column:
    return F.length(seq).between(least, most)


def region(text: Column, start: int, end: int) -> Column:
    """[start, end), from 0; an error if start >= end or the text is shorter than ``end``."""
    if start >= end:
        raise ValueError("start must be below end")
    return F.when(F.length(text) >= end, F.substring(text, start + 1, end - start)).otherwise(F.raise_error(F.lit("region ends beyond the sequence")))


def trim(text: Column, start: int = 0, end: int = 0) -> Column:
    """Without so many characters at either end, to '' at least."""
    return F.substr(text, F.lit(start + 1), F.greatest(F.length(text) - start - end, F.lit(0)))


def _poor(least: int) -> str:
    """Class of quality characters below ``least``."""
    return "" if least <= 0 else "[" + "".join("\\" + c if not c.isalnum() else c for c in map(chr, range(33, min(33 + least, 127)))) + "]"


def quality_end(qual: Column, least: int) -> Column:
    """Length up to the last base of at least that quality."""
    return F.length(F.regexp_replace(qual, f"{_poor(least)}+$", "")) if least > 0 else F.length(qual)


def quality_start(qual: Column, least: int) -> Column:
    """Bases before the first one of at least that quality."""
    return F.length(qual) - F.length(F.regexp_replace(qual, f"^{_poor(least)}+", "")) if least > 0 else F.lit(0)


def trim_quality(text: Column, qual: Column, least: int, start: bool = True, end: bool = True) -> Column:
    """``text`` (the sequence or the quality) cut to the outermost bases of at least that quality."""
    skip = quality_start(qual, least) if start else F.lit(0)
    stop = quality_end(qual, least) if end else F.length(qual)
    return F.substr(text, skip + 1, F.greatest(stop - skip, F.lit(0)))


def window_cut(qual: Column, least: int, width: int) -> Column:
    """Length to keep: the end of the last window whose truncated mean quality suffices; none does: everything.

    A text below the width is kept or dropped as a whole by its truncated mean; an empty one stays empty. Sums of windows are
    differences of one running sum over some hundred thousand of a batch's bytes.
    """
    if width < 1:
        raise ValueError("the window needs a width")

    def some(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, base = np.diff(ends), ends[0]
        upto = np.concatenate(([0], np.cumsum(data[base : ends[-1]].astype(np.int64) - 33)))
        starts, stops = ends[:-1] - base, ends[1:] - base
        out = np.where((n > 0) & ((upto[stops] - upto[starts]) // np.maximum(n, 1) >= least), n, 0)
        full = n >= width
        if full.any():
            # By each end of a window the last end, up to there, of one that suffices; it must lie in the read.
            good = np.zeros(len(upto), np.int64)
            good[width:] = np.where((upto[width:] - upto[:-width]) // width >= least, np.arange(width, len(upto)), 0)
            last = np.maximum.accumulate(good)[stops]
            out = np.where(full, np.where(last >= starts + width, last - starts, n), out)
        return out

    @F.arrow_udf(T.IntegerType())
    def cut(qual: pa.Array) -> pa.Array:
        ends = np.frombuffer(qual.buffers()[1], np.int32)[qual.offset : qual.offset + len(qual) + 1].astype(np.int64)
        data = np.frombuffer(qual.buffers()[2] or b"", np.uint8)
        kept, at = [np.zeros(0, np.int64)], 0
        while at < len(qual):
            stop = max(int(np.searchsorted(ends, ends[at] + 500_000, "right")) - 1, at + 1)
            kept.append(some(data, ends[at : stop + 1]))
            at = stop
        return pa.array(np.concatenate(kept).astype(np.int32), mask=qual.is_null().to_numpy(zero_copy_only=False))

    return cut(qual)


def mask_low_quality(seq: Column, qual: Column, least: int) -> Column:
    """Bases below that quality become N."""
    pairs = F.zip_with(F.split(seq, ""), F.split(qual, ""), lambda b, q: F.when(F.ascii(q) < least + 33, F.when(b == "", "").otherwise("N")).otherwise(b))
    return F.array_join(pairs, "")


def count_masked(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "Nn", ""))).cast("bigint")
