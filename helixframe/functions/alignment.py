"""CIGAR strings, flags, and the derived values of alignment, variant and match records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.sequence import let

# Flag bits of alignment records.
FLAGS = {"paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20, "first": 0x40, "second": 0x80, "secondary": 0x100, "qc_fail": 0x200, "duplicate": 0x400, "supplementary": 0x800}
REFERENCE_OPS, QUERY_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X")


def has(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def is_mapped(flags: Column) -> Column:
    return ~has(flags, "unmapped")


def is_primary(flags: Column) -> Column:
    return ~has(flags, "secondary") & ~has(flags, "supplementary")


def is_forward(flags: Column) -> Column:
    return ~has(flags, "reverse")


def parse_cigar(cigar: Column) -> Column:
    """Array of (len, op); ``*``, null and empty give an empty array."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), 1)
    return F.transform(found, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def format_cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def compress_cigar(ops: Column) -> Column:
    """Adjacent equal operations joined."""
    empty = F.array().cast("array<struct<len:int,op:string>>")

    def step(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joined = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct((last["len"] + x["len"]).alias("len"), x["op"].alias("op"))))
        return F.when(last["op"] == x["op"], joined).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(ops, empty, step)


def cigar_length(ops: Column, kinds: tuple[str, ...] = REFERENCE_OPS) -> Column:
    """Sum of the lengths of operations of these kinds: on the reference, or with QUERY_OPS on the read."""
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0), lambda a, x: a + x["len"])


def is_snp(ref: Column, alt: Column) -> Column:
    """One reference base and all alternatives of one base; also without alternatives."""
    return (F.length(ref) == 1) & F.forall(alt, lambda a: F.length(a) == 1)


def is_insertion(ref: Column, alt: Column) -> Column:
    return F.exists(alt, lambda a: F.length(a) > F.length(ref))


def is_deletion(ref: Column, alt: Column) -> Column:
    return F.exists(alt, lambda a: F.length(a) < F.length(ref))


def is_indel(ref: Column, alt: Column) -> Column:
    return is_insertion(ref, alt) | is_deletion(ref, alt)


def fraction(part: Column, whole: Column) -> Column:
    """Share of a whole; 0 of nothing. Identity and coverage of matches."""
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def is_high_quality(mapq: Column, least: int) -> Column:
    return (mapq >= least) & (mapq < 255)


def blast_coverage(start: Column, end: Column) -> Column:
    """Positions from start to end; 1 on the other strand."""
    return F.greatest(end - start, F.lit(0)) + 1


def mismatches(read: Column, reference: Column) -> Column:
    """Array of (position, base, expected) where a read differs from the reference, as far as both go; letters count as they are."""
    pairs = F.arrays_zip(F.split(read, "").alias("base"), F.split(reference, "").alias("expected"))
    placed = F.transform(pairs, lambda x, i: F.struct(i.alias("position"), x["base"].alias("base"), x["expected"].alias("expected")))
    both = F.slice(placed, F.lit(1), F.least(F.length(read), F.length(reference)))
    return F.filter(both, lambda x: x["base"] != x["expected"])


@F.arrow_udf(T.StructType().add("positions", T.ArrayType(T.IntegerType())).add("bases", T.StringType()).add("expected", T.StringType()))
def _differences(read: pa.Array, reference: pa.Array) -> pa.Array:
    bases, expected, counts, places = [], [], [], []
    for x, y in zip(read.to_pylist(), reference.to_pylist()):
        if x is None or y is None:
            at, x, y = np.zeros(0, np.int32), "", ""
        else:
            n = min(len(x), len(y))
            x, y = (np.frombuffer(s[:n].encode("utf-32-le"), np.uint32) for s in (x, y))
            at = np.flatnonzero(x != y).astype(np.int32)
            x, y = (s[at].tobytes().decode("utf-32-le") for s in (x, y))
        bases.append(x), expected.append(y), counts.append(len(at)), places.append(at)
    ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *places])))
    gone = pc.or_(read.is_null(), reference.is_null())
    return pa.StructArray.from_arrays([lists, pa.array(bases, pa.string()), pa.array(expected, pa.string())], ["positions", "bases", "expected"], mask=gone)


@F.arrow_udf(T.StringType())
def _substituted(reference: pa.Array, positions: pa.Array, bases: pa.Array) -> pa.Array:
    out = []
    for text, at, letters in zip(reference, positions, bases.to_pylist()):
        text = text.as_py()
        if text is not None and at.is_valid and letters is not None:
            codes, at = np.array(np.frombuffer(text.encode("utf-32-le"), np.uint32)), at.values.to_numpy()
            inside = (at >= 0) & (at < len(codes))
            codes[at[inside]] = np.frombuffer(letters.encode("utf-32-le"), np.uint32)[inside]
            text = codes.tobytes().decode("utf-32-le")
        else:
            text = None
        out.append(text)
    return pa.array(out, pa.string())


def differences(read: Column, reference: Column) -> Column:
    """``mismatches`` as a struct of the positions, the read's letters there and the reference's, a letter for each position."""
    return _differences(read, reference)


def substituted(reference: Column, positions: Column, bases: Column) -> Column:
    """The reference with other letters at these positions, one for a position; beyond its end nothing changes."""
    return _substituted(reference, positions, bases)


def apply_substitutions(reference: Column, substitutions: Column) -> Column:
    """The reference with other bases at the positions of (position, base), one for a position; beyond its end nothing changes.

    What lies between two substitutions is cut out once.
    """

    def restored(v: Column) -> Column:
        after = lambda i: F.when(i < 0, F.lit(-1)).otherwise(F.get(v["subs"], i)["position"]) + 2
        between = lambda x, i: F.array_join(F.slice(v["letters"], after(i - 1), x["position"] + 1 - after(i - 1)), "")
        pieces = F.transform(v["subs"], lambda x, i: F.concat(between(x, i), x["base"]))
        tail = F.array_join(F.slice(v["letters"], after(F.size(v["subs"]) - 1), F.size(v["letters"])), "")
        return F.concat(F.array_join(pieces, ""), tail)

    placed = F.array_sort(F.transform(substitutions, lambda x: F.struct(x["position"].cast("int").alias("position"), x["base"].alias("base"))))
    inside = let(F.struct(F.length(reference).alias("n"), placed.alias("subs")), lambda v: F.filter(v["subs"], lambda x: (x["position"] >= 0) & (x["position"] < v["n"])))
    return let(F.struct(F.split(reference, "").alias("letters"), inside.alias("subs")), restored)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals of one chromosome."""
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def sra_url(accession: Column, base: str) -> Column:
    """``base/accession/accession``; null unless it is a run, experiment, sample or project accession."""
    return F.when(accession.rlike("^SR[RXSP][0-9]{4,}$"), F.concat_ws("/", F.lit(base), accession, accession))
