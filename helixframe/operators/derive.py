"""Genomics-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values shared with the SQL: letters kept, the bases and the qualities that they stand for.
LETTERS, BASES, QUALS = "aeiotnsr", "ACGTACNG", "!+5?IDG:"
CIGARS = ["100M", "50M5I45M", "40M10D50M", "10S80M10S", "45M1000N55M", "20H80M20H", "5S30M2I20M3D38M5S"]

READS = f"""reads AS (SELECT doc_id AS id, lang, translate(raw, '{LETTERS}', '{BASES}') AS seq, reverse(translate(raw, '{LETTERS}', '{QUALS}')) AS qual
  FROM (SELECT doc_id, lang, regexp_replace(text, '[^{LETTERS}]', '', 'g') AS raw FROM documents))"""
INTERVALS = """intervals AS (SELECT event_id AS id, user_id % 4 AS chrom, floor(epoch(ts))::BIGINT % 100000 AS start, floor(epoch(ts))::BIGINT % 100000 + 1 + floor(value)::BIGINT AS "end" FROM events)"""
_ALIGNED = """SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS reference_id, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_suppkey % 4 END AS mate_reference_id,
  l_partkey * 50 AS position, CASE WHEN l_quantity = 50 THEN NULL ELSE CAST(l_quantity AS INT) END AS mapq,
  1 + CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END + CASE WHEN l_quantity = 1 THEN 4 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
    + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END + CASE WHEN l_tax > 0.075 THEN 512 ELSE 0 END
    + CASE WHEN l_discount > 0.095 THEN 1024 ELSE 0 END + CASE WHEN l_linenumber = 6 THEN 2048 ELSE 0 END AS flags,
  CASE """ + " ".join(f"WHEN l_linenumber = {i + 1} THEN '{c}'" for i, c in enumerate(CIGARS[:-1])) + f""" ELSE '{CIGARS[-1]}' END AS cigar,
  CAST(floor(l_extendedprice) AS BIGINT) % 1000 - 500 AS template_length, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) END AS nm FROM """
ALIGNMENTS = f"alignments AS ({_ALIGNED} lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table with less than a scan partition for each core is dealt to the cores, so that dear expressions use them all.

    Larger tables stay as they are: their scan has tasks enough, and a shuffle of theirs would cost more than it gives.
    """
    spark = df.sparkSession
    cores, most = spark.sparkContext.defaultParallelism, df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * most
    return df.repartition(cores) if small else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, lang, seq, qual`` from whole texts.

    They come out of a generator, through which no filter is pushed, so each is computed once however often it is mentioned.
    """
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select(F.col("doc_id").alias("id"), "lang", F.regexp_replace("text", f"[^{LETTERS}]", "").alias("raw"))
    made = F.struct(F.translate("raw", LETTERS, BASES).alias("seq"), F.reverse(F.translate("raw", LETTERS, QUALS)).alias("qual"))
    return raw.select("id", "lang", F.inline(F.array(made)))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, chrom, start, end`` from events."""
    second = F.unix_seconds(F.col("ts").cast("timestamp")) % 100000
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("chrom"), second.alias("start"), (second + 1 + F.floor("value")).cast("bigint").alias("end"))


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ALIGNED + "{lineitem}", lineitem=table(spark, sf_dir, "lineitem"))
