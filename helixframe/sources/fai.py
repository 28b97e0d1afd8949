"""FASTA indexes and regions of sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND = pa.schema([("name", pa.string()), ("length", pa.int64()), ("offset", pa.int64()), ("line_bases", pa.int32()), ("line_width", pa.int32())])


def entries(content: bytes) -> Iterator[dict]:
    """Index rows of one FASTA file; lines of a sequence must be of one width but for the last."""
    at = 0 if content[:1] == b">" else content.find(b"\n>") + 1
    while at < len(content) and content[at : at + 1] == b">":
        line = content.find(b"\n", at)
        name, start = content[at + 1 : line].split()[0].decode(), line + 1
        end = content.find(b"\n>", line)
        end = len(content) if end < 0 else end + 1
        lines = content[start:end].splitlines(keepends=True)
        while lines and not lines[-1].strip():
            lines.pop()
        sizes = [len(x.strip()) for x in lines]
        width = len(lines[0]) if lines else 0
        if any(len(x) != width for x in lines[:-1]) or (lines and sizes[-1] > sizes[0]):
            raise ValueError(f"lines of {name} differ in width")
        yield {"name": name, "length": sum(sizes), "offset": start, "line_bases": sizes[0] if sizes else 0, "line_width": width}
        at = end


def build_fai(spark: SparkSession, path: str) -> DataFrame:
    """The index of FASTA files, each read by one task: byte offsets need what lies before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist(list(entries(content.as_py())), _KIND)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, length bigint, offset bigint, line_bases int, line_width int")


def byte_offset(position: Column) -> Column:
    """A base's place in its file, by the index's columns."""
    return F.col("offset") + F.floor(position / F.col("line_bases")) * F.col("line_width") + position % F.col("line_bases")


def fetch_region(sequences: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """``id, sequence`` of [start, end), cut at the sequence's end; an empty region or one past the end is an error."""
    fine = (F.lit(start) < end) & (F.length("sequence") > start)
    cut = F.when(fine, F.substring("sequence", start + 1, max(end - start, 0))).otherwise(F.raise_error(F.lit(f"no bases in {name}:{start}-{end}")))
    return sequences.where(F.col("id") == name).select("id", cut.alias("sequence"))
