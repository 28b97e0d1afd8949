"""K-mers, hashes and minimizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 64-bit FNV-1a offset basis as high and low half; the prime is 2**40 + 435.
FNV_HIGH, FNV_LOW, FNV_SMALL = 3421674724, 2216829733, 435
FNV_PRIME = (1 << 40) + FNV_SMALL
# ntHash seeds of the bases.
NT_SEEDS = {"A": 4362857412768957556, "C": 3572411708064410444, "G": 2319985823310095140, "T": 2978368046464386134}
_MASK = 0xFFFFFFFF


def kmers(seq: Column, k: int) -> Column:
    """All overlapping upper-case A, C, G, T runs of ``k``, in order. A lookahead finds them in one pass; none if k < 1."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), 1) if k > 0 else F.array().cast("array<string>")


def windows(seq: Column, k: int) -> Column:
    """All substrings of ``k`` characters, valid or not, so that the index is the position."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


def is_valid_kmer(kmer: Column) -> Column:
    return kmer.rlike("^[ACGT]+$")


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of ASCII text as a struct of unsigned halves (hi, lo), which compares as the unsigned number."""
    start = F.struct(F.lit(FNV_HIGH).cast("bigint").alias("hi"), F.lit(FNV_LOW).cast("bigint").alias("lo"))

    def step(a: Column, c: Column) -> Column:
        low = a["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        product = low * FNV_SMALL
        high = a["hi"] * FNV_SMALL + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), product.bitwiseAND(F.lit(_MASK)).alias("lo"))

    return F.aggregate(F.split(text, ""), start, lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _rotl(x: Column, n: Column) -> Column:
    n = n % 64
    return F.when(n == 0, x).otherwise(F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - n)))


def _seed(base: Column, complemented: bool = False) -> Column:
    pair = {"A": "T", "C": "G", "G": "C", "T": "A"}
    out = F.lit(0).cast("bigint")
    for b, v in NT_SEEDS.items():
        out = F.when(base == (pair[b] if complemented else b), F.lit(v)).otherwise(out)
    return out


def nthash(kmer: Column, k: int, canonical: bool = True) -> Column:
    """ntHash of a k-mer as a long: forward, or the unsigned lesser of forward and reverse complement."""
    bases = F.filter(F.split(kmer, ""), lambda c: c != "")
    indexed = F.transform(bases, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    zero = F.lit(0).cast("bigint")
    forward = F.aggregate(indexed, zero, lambda a, x: a.bitwiseXOR(_rotl(_seed(x["b"]), k - 1 - x["i"])))
    if not canonical:
        return forward
    back = F.aggregate(indexed, zero, lambda a, x: a.bitwiseXOR(_rotl(_seed(x["b"], True), x["i"])))
    flip = F.lit(-(1 << 63))
    return F.when(forward.bitwiseXOR(flip) <= back.bitwiseXOR(flip), forward).otherwise(back)
