"""Values that records of the read formats imply: typed tags, coordinates, names, shares and predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.alignment import fraction

# The tag of each named value of an alignment, and its type.
ALIGNMENT_TAGS = {"edit_distance": ("NM", "bigint"), "alignment_score": ("AS", "bigint"), "mate_mapping_quality": ("MQ", "bigint"), "read_group": ("RG", "string"), "mismatches": ("MD", "string")}


def tag(tags: Column, key: str, kind: str = "string") -> Column:
    """A tag's value without its type letter, as ``kind``; null where it is absent or no such value."""
    return F.regexp_replace(tags[key], "^[^:]*:", "").try_cast(kind)


def tag_numbers(tags: Column, key: str) -> Column:
    """The numbers of an array tag; null for other tags."""
    items = F.split(F.regexp_replace(tags[key], "^B:[a-zA-Z],?", ""), ",")
    return F.when(tags[key].startswith("B:"), F.transform(F.filter(items, lambda x: x != ""), lambda x: x.cast("double")))


def alignment_tag(tags: Column, name: str) -> Column:
    """A named value of ``ALIGNMENT_TAGS``."""
    return tag(tags, *ALIGNMENT_TAGS[name])


def interval_start(start: Column) -> Column:
    """Where a feature counted from 1 begins when counted from 0; its end, then left out, stays."""
    return start - 1


def feature_length(start: Column, end: Column) -> Column:
    """Length of a feature counted from 1 whose end belongs to it."""
    return end - start + 1


def attribute(attributes: Column, *names: str) -> Column:
    """The first of these attributes that is there."""
    return F.coalesce(*[attributes[n] for n in names])


def gene_biotype(attributes: Column) -> Column:
    return attribute(attributes, "gene_biotype", "gene_type")


def is_significant(p_value: Column, q_value: Column, least_p: float, least_q: float) -> Column:
    """Both -log10 values reach their least; one that is absent counts as -1."""
    return (F.coalesce(p_value, F.lit(-1.0)) >= least_p) & (F.coalesce(q_value, F.lit(-1.0)) >= least_q)


def aligned_share(start: Column, end: Column, length: Column) -> Column:
    """Share of a query or target that a match covers."""
    return fraction(end - start, length)


def aligned_length(start: Column, end: Column) -> Column:
    """Positions of a query or target that a match covers, its end left out."""
    return end - start


def is_good_match(identity: Column, evalue: Column, least_identity: float, most_evalue: float) -> Column:
    """A tabular match of at least this percent identity and at most this e-value."""
    return (identity >= least_identity) & (evalue <= most_evalue)


def segment_coverage(tags: Column) -> Column:
    """The KC tag of a graph's segment."""
    return tag(tags, "KC", "double")


def passes(filters: Column) -> Column:
    """A variant whose only filter is PASS."""
    return F.coalesce(filters == "PASS", F.lit(False))


def variant_end(pos: Column, ref: Column) -> Column:
    """End, left out, of the reference allele counted from 0."""
    return pos - 1 + F.length(ref)


def sample_value(form: Column, sample: Column, key: str) -> Column:
    """One of a sample's values by its key in the format column; null where the key or the value is absent."""
    at = F.array_position(F.split(form, ":"), key).cast("int")
    value = F.get(F.split(sample, ":"), at - 1)
    return F.when((at > 0) & (value != "."), value)
