"""Feature hierarchies and assembly graphs as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children(parents: DataFrame, kids: DataFrame, count: str) -> DataFrame:
    """Every parent (``id``) and the number of rows whose ``parent`` it is."""
    counted = kids.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias(count))
    return parents.join(counted, "id", "left").withColumn(count, F.coalesce(count, F.lit(0)))


def utr_lengths(utrs: DataFrame) -> DataFrame:
    """Summed lengths before and after the coding part per transcript (``parent, side, strand, start, end``, 1-based, ends included).

    On the reverse strand left and right swap.
    """
    n = (F.col("end") - F.col("start") + 1).cast("bigint")
    five = (F.col("side") == "left") == (F.col("strand") == "+")
    return utrs.groupBy("parent").agg(F.sum(F.when(five, n).otherwise(0)).alias("five_prime"), F.sum(F.when(five, 0).otherwise(n)).alias("three_prime"))


def degrees(segments: DataFrame, links: DataFrame) -> DataFrame:
    """In- and out-degree of every segment (``name``) over links (``from_segment, to_segment``)."""
    out = links.groupBy(F.col("from_segment").alias("name")).agg(F.count("*").alias("out_degree"))
    into = links.groupBy(F.col("to_segment").alias("name")).agg(F.count("*").alias("in_degree"))
    joined = segments.select("name").join(into, "name", "left").join(out, "name", "left")
    return joined.select("name", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def ends(segments: DataFrame, links: DataFrame) -> DataFrame:
    """Segments that no link enters (source) or leaves (sink).

    Links are reduced to names before the shuffle, so that a task holds no name twice, whatever a segment's degree.
    """
    named = lambda c: links.select(F.col(c).alias("name")).distinct()
    source = segments.join(named("to_segment"), "name", "left_anti").select("name", F.lit("source").alias("kind"))
    sink = segments.join(named("from_segment"), "name", "left_anti").select("name", F.lit("sink").alias("kind"))
    return source.unionByName(sink)


def path_lengths(paths: DataFrame, segments: DataFrame) -> DataFrame:
    """Summed segment lengths of each path (``name, steps`` with an orientation sign at each step's end)."""
    steps = paths.select(F.col("name").alias("path"), F.explode("steps").alias("s")).select("path", F.regexp_replace("s", "[+-]$", "").alias("name"))
    return steps.join(segments.select("name", "length"), "name").groupBy("path").agg(F.sum("length").alias("bases"), F.count("*").alias("steps"))


def totals(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of segments and links, and the segments' total, shortest, longest and mean length."""
    s = segments.agg(F.count("*").alias("segments"), F.sum("length").alias("bases"), F.min("length").alias("shortest"), F.max("length").alias("longest"), F.avg("length").alias("mean"))
    return s.crossJoin(F.broadcast(edges.agg(F.count("*").alias("links"))))
