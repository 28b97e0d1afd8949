"""Statistics over alignment tables: ``reference_id, position, mapq, flags, cigar, template_length, nm`` and so on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import alignment as A
from helixframe.operators import intervals

#: References of a header that may be broadcast.
NAMES = 100_000


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def flag_counts(df: DataFrame) -> DataFrame:
    """One row of twelve counters; an unmapped read on neither strand counts as forward."""
    f = F.col("flags")
    counters = {"total": F.lit(True), "mapped": A.is_mapped(f), "unmapped": A.has(f, "unmapped"), "primary_reads": A.is_primary(f), "secondary": A.has(f, "secondary"), "supplementary": A.has(f, "supplementary"), "paired": A.has(f, "paired"), "proper_pair": A.has(f, "proper_pair"), "forward": A.is_forward(f), "reverse": A.has(f, "reverse"), "qc_fail": A.has(f, "qc_fail"), "duplicate": A.has(f, "duplicate")}
    return df.agg(*[_count(c).alias(n) for n, c in counters.items()])


def mapq_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("mapq", F.lit(255)).alias("mapq")).agg(F.count("*").alias("n"))


def insert_sizes(df: DataFrame) -> DataFrame:
    """Histogram of template lengths over proper primary pairs on one reference (two nulls are one)."""
    f = F.col("flags")
    kept = df.where(A.has(f, "paired") & A.has(f, "proper_pair") & A.is_primary(f) & F.col("reference_id").eqNullSafe(F.col("mate_reference_id")))
    return kept.select(F.abs("template_length").alias("insert_size")).where("insert_size > 0").groupBy("insert_size").agg(F.count("*").alias("n"))


def edit_distance_stats(df: DataFrame) -> DataFrame:
    """Counts, mean, upper median, least and greatest edit distance.

    The median is found in the histogram of distances, whose size doesn't grow with the reads.
    """
    histogram = df.groupBy("nm").agg(F.count("*").alias("n"))
    w = Window.orderBy("nm")
    ranked = histogram.where("nm is not null").select("nm", "n", F.sum("n").over(w).alias("upto"))
    whole = ranked.agg(F.sum("n").alias("with_nm"), (F.sum(F.col("nm") * F.col("n")) / F.sum("n")).alias("mean"), F.min("nm").alias("least"), F.max("nm").alias("greatest"))
    median = ranked.crossJoin(F.broadcast(whole.select("with_nm"))).where("upto > floor(with_nm / 2)").agg(F.min("nm").alias("median"))
    total = histogram.agg(F.sum("n").alias("total"))
    return total.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(median)).select("total", "with_nm", "mean", "median", "least", "greatest")


def with_end(df: DataFrame) -> DataFrame:
    """Adds the length on the reference and the end."""
    return df.withColumn("reference_length", A.cigar_length(A.parse_cigar(F.col("cigar")))).withColumn("end", F.col("position") + F.col("reference_length"))


def region_query(df: DataFrame, reference_id: int, start: int, end: int) -> DataFrame:
    """Reads that overlap [start, end); those without a length on the reference don't."""
    near = df.where((F.col("reference_id") == reference_id) & (F.col("position") < end))
    return with_end(near).where((F.col("end") > start) & (F.col("reference_length") > 0))


def region_starts(df: DataFrame, reference_id: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Reads that start in [start, end); the filter reaches the scan."""
    out = df.where(F.col("reference_id") == reference_id)
    out = out if start is None else out.where(F.col("position") >= start)
    return out if end is None else out.where(F.col("position") < end)


def strand_bias(df: DataFrame, reference_id: int, position: int, window: int) -> DataFrame:
    half = int(window / 2)
    near = region_query(df, reference_id, position - half, position + half + 1)
    forward, total = F.count_if(A.is_forward(F.col("flags"))), F.count("*")
    return near.agg(forward.alias("forward"), (total - forward).alias("reverse"), total.alias("total"), F.when(total == 0, 0.0).otherwise(forward / F.nullif(total, F.lit(0))).alias("ratio"))


def alignment_lengths(df: DataFrame) -> DataFrame:
    kept = with_end(df.where(A.is_mapped(F.col("flags")))).where("reference_length > 0")
    return kept.groupBy("reference_length").agg(F.count("*").alias("n"))


def cigar_totals(df: DataFrame) -> DataFrame:
    ops = df.select(F.explode(A.parse_cigar(F.col("cigar"))).alias("c"))
    return ops.groupBy(F.col("c.op").alias("op")).agg(F.sum(F.col("c.len").cast("bigint")).alias("bases"), F.count("*").alias("n"))


def _blocks(df: DataFrame) -> DataFrame:
    """``bin_, start, end`` and the reference of the blocks of matching bases, in each bin that one touches; a batch's CIGARs are parsed once each."""
    kind = df.schema["reference_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            starts, ends, counts = [], [], []
            for cigar in coded.dictionary.to_pylist():
                at, counts = 0, [*counts, 0]
                for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar):
                    to = at + (int(n) if op in A.REFERENCE_OPS else 0)
                    if op in "M=X":
                        starts, ends, counts[-1] = [*starts, at], [*ends, to], counts[-1] + 1
                    at = to
            codes, n = coded.indices.to_numpy(), np.array(counts, np.int64)
            row = np.repeat(np.arange(len(codes)), n[codes])
            upto = np.cumsum(n[codes])
            block = np.arange(len(row)) - np.repeat(upto - n[codes], n[codes]) + (np.cumsum(n) - n)[codes[row]]
            place = batch.column(1).to_numpy()[row]
            start, end = place + np.array(starts, np.int64)[block], place + np.array(ends, np.int64)[block]
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                first = start[part] >> intervals.BIN
                copies = np.maximum(((end[part] - 1) >> intervals.BIN) - first, 0) + 1
                which = np.repeat(np.arange(len(first)), copies)
                bins = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[part][which])), pa.array(bins), pa.array(start[part][which]), pa.array(end[part][which])], ["reference_id", "bin_", "start", "end"])

    whole = df.where(F.col("reference_id").isNotNull() & F.col("position").isNotNull() & F.col("cigar").isNotNull())
    return whole.select("reference_id", F.col("position").cast("bigint"), "cigar").mapInArrow(run, f"reference_id {kind}, bin_ bigint, start bigint, end bigint")


def bases_at(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Depth of matching bases at each site (``reference_id, position``) that has any.

    CIGAR blocks meet a bin's sites, of which there are no more than positions: each block adds one where its sites begin and takes
    one where they end, so that its pairs with sites are never made.
    """
    kind = sites.schema["reference_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known, changes = None, [], None

        def counted() -> Iterator[pa.RecordBatch]:
            if changes is not None and changes.any():
                depth = np.cumsum(changes[:-1]) * held[1]
                at = np.flatnonzero(depth)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at), reference), pa.array(held[0][at]), pa.array(depth[at])], ["reference_id", "position", "depth"])

        for batch in batches:
            reference = batch.schema.field("reference_id").type
            bins, side, start, end = (batch.column(c).to_numpy() for c in ("bin_", "side_", "start", "end"))
            names = batch.column("reference_id").dictionary_encode()
            codes, values = names.indices.to_numpy(), names.dictionary.to_pylist()
            new = np.flatnonzero((bins[1:] != bins[:-1]) | (codes[1:] != codes[:-1]) | (side[1:] != side[:-1])) + 1
            for at, stop in zip([0, *new], [*new, len(batch)]):
                if (values[codes[at]], bins[at]) != key:
                    yield from counted()
                    key, known, changes = (values[codes[at]], bins[at]), [], None
                if side[at] == 0:
                    known.append((start[at:stop], end[at:stop]))
                elif known:
                    if changes is None:
                        held = [np.concatenate(x) for x in zip(*known)]
                        changes = np.zeros(len(held[0]) + 1, np.int64)
                    low, high = (np.searchsorted(held[0], x[at:stop], "left") for x in (start, end))
                    changes += np.bincount(low, minlength=len(changes)) - np.bincount(high, minlength=len(changes))
        yield from counted()

    place = F.col("position").cast("bigint")
    counts = sites.where(F.col("reference_id").isNotNull()).groupBy("reference_id", place.alias("start")).agg(F.count("*").alias("end"))
    both = counts.where("start is not null").select("reference_id", F.shiftright("start", intervals.BIN).alias("bin_"), "start", "end", F.lit(0).alias("side_")).unionByName(_blocks(df).withColumn("side_", F.lit(1)))
    dealt = both.repartition("reference_id", "bin_").sortWithinPartitions("reference_id", "bin_", "side_", F.when(F.col("side_") == 0, F.col("start")))
    return dealt.mapInArrow(run, f"reference_id {kind}, position bigint, depth bigint")


def n50(df: DataFrame, by: str, length: str) -> DataFrame:
    """The length at which the longer ones hold half of all bases, for each group; from a histogram, so that only lengths are sorted."""
    counts = df.groupBy(by, F.col(length).alias("n")).agg(F.count("*").alias("k"))
    held = counts.withColumn("bases", F.col("n") * F.col("k"))
    upto, total = F.sum("bases").over(Window.partitionBy(by).orderBy(F.desc("n"))), F.sum("bases").over(Window.partitionBy(by))
    return held.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") * 2 >= F.col("total")).groupBy(by).agg(F.max("n").alias("n50"))


def by_reference_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """``name, n`` by the references' names (``id, name``); without one ``*``. Alignments are counted before they are named.

    The names are broadcast if they are as few as a header's, else joined by a shuffle of the counts.
    """
    counts = df.groupBy("reference_id").agg(F.count("*").alias("n"))
    few = names.limit(NAMES + 1).count() <= NAMES
    named = counts.join(F.broadcast(names) if few else names, F.col("reference_id") == F.col("id"), "left")
    return named.groupBy(F.coalesce("name", F.lit("*")).alias("name")).agg(F.sum("n").alias("n"))


def coverage_bins(df: DataFrame, width: int) -> DataFrame:
    """``reference_id, bin, bases, covered``: depth over the reference spans of mapped alignments, by ``width`` positions."""
    spans = df.where(~A.has(F.col("flags"), "unmapped")).select(F.col("reference_id").alias("chrom"), F.col("position").cast("bigint").alias("start"), (F.col("position") + A.cigar_length(A.parse_cigar(F.col("cigar")))).cast("bigint").alias("end"))
    depth = intervals.depth(spans.where(F.col("start") < F.col("end")))
    return depth.groupBy(F.col("chrom").alias("reference_id"), F.floor(F.col("position") / width).alias("bin")).agg(F.sum("depth").alias("bases"), F.count("*").alias("covered"))


def coverage_of_starts(df: DataFrame, reference_id: int, start: int, end: int) -> DataFrame:
    """``position, depth`` in [start, end) of the reads that start there: a read that reaches in from the left doesn't count."""
    spans = with_end(region_starts(df, reference_id, start, end))
    clipped = spans.select(F.col("reference_id").alias("chrom"), F.col("position").cast("bigint").alias("start"), F.least(F.col("end"), F.lit(end)).cast("bigint").alias("end"))
    return intervals.depth(clipped.where(F.col("start") < F.col("end"))).select("position", "depth")


def qc_report(df: DataFrame) -> DataFrame:
    """One row of a run's quality figures in one pass."""
    f, flag = F.col("flags"), lambda n: _count(A.has(F.col("flags"), n)).alias({"proper_pair": "proper", "duplicate": "duplicates"}.get(n, n))
    length = A.cigar_length(A.parse_cigar(F.col("cigar")))
    return df.agg(F.count("*").alias("n"), _count(A.is_mapped(f)).alias("mapped"), flag("proper_pair"), flag("duplicate"), flag("secondary"), _count(F.col("mapq") >= 30).alias("high_mapq"), F.avg("mapq").alias("mean_mapq"), F.sum("nm").alias("edits"), F.max(F.abs("template_length")).alias("longest_insert"), F.sum(length).alias("reference_bases"))


def depth_shares(depth: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """``chrom, covered, share_<n>, median``: of the covered positions the share with a depth of ``n`` or more."""
    shares = [(_count(F.col("depth") >= n) / F.count("*")).alias(f"share_{n}") for n in least]
    return depth.groupBy("chrom").agg(F.count("*").alias("covered"), *shares, F.percentile("depth", 0.5).alias("median"))
