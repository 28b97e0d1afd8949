"""Alignments as columns: Parquet files in order of place, so that a region's rows are found by the row groups' statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import alignment as A

#: The column that is added: where a read's span on its reference ends.
END = "end_position"


def write_columns(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """Alignment records by ranges of (reference, position), however many reads one reference has; unplaced reads come first."""
    spanned = df.withColumn(END, F.col("position") + A.cigar_length(A.parse_cigar(F.col("cigar"))))
    # Ranges are cut at names and flags too, so that one place with very many reads isn't one task's.
    ordered = spanned.repartitionByRange("reference", "position", "name", "flags").sortWithinPartitions("reference", "position")
    ordered.write.option("compression", codec).parquet(path)


def read_columns(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None) -> DataFrame:
    """The records that were written; with ``region`` (reference, start, end) those that overlap it, by filters that reach the scan."""
    out = spark.read.parquet(path)
    if region:
        reference, start, end = region
        out = out.where((F.col("reference") == reference) & (F.col("position") < end) & (F.col(END) > start) & (F.col(END) > F.col("position")))
    return out.drop(END)
