"""Block-compressed files of binary records, read by many tasks.

Spark's text source cuts a file at any separator, here the first bytes of a block, so that each split begins with a whole block
at any path that Spark reads. Records don't begin where blocks do. The first record of a split is guessed from its bytes and
proved afterwards: what is left at a split's end and what comes before the next split's first record must be whole records,
together. As the file's first record is known, a file whose borders all close has been cut rightly. Any other is an error: its
end is missing, or a record holds bytes that look like records; in splits as large as that file nothing is guessed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import scratch
from helixframe.sources.bgzf import BlockReader, deflate_block

#: What the blocks of all usual writers begin with. Blocks that begin otherwise stay with the block before them.
SEPARATOR = deflate_block(b"")[:16]
#: Records in a row that must look right where a split's first one is guessed, fewer at the split's end.
CHAIN = 4
#: Bytes of headers that go to the tasks of one scan; files with more are read by several scans.
HEADERS = 32 << 20
#: Inflated bytes that are held, at least, before the records in them are parsed together.
RUN = 1 << 20
_RAW = "file string, block bigint, data binary"
_SEAMS = "file string, block bigint, begun boolean, head binary, tail binary"


class Rule(NamedTuple):
    """A format: bytes of its header and of the record at a place (None: not all there), and whether a record can begin there."""

    header: Callable[[bytes], int | None]
    size: Callable[[bytes, int], int | None]
    fits: Callable[[bytes, int], bool | None]
    #: What is kept of a header, and what of it a record is read with.
    kept: Callable[[bytes], bytes]
    known: Callable[[bytes], Any]


class Split:
    """The inflated bytes of one split: ``head`` before the first record, its records, ``tail`` after the last whole one."""

    def __init__(self, parts: Iterable[bytes], rule: Rule, first: bool):
        self.parts, self.rule, self.first = iter(parts), rule, first
        self.held, self.begun, self.head, self.tail = bytearray(), False, b"", b""

    def _more(self) -> bool:
        part = next(self.parts, None)
        self.held += part or b""
        return part is not None

    def _chain(self, at: int) -> tuple[bool | None, int]:
        """Whether a chain of records begins here (None if more bytes are needed to tell), and how many look right."""
        for n in range(CHAIN):
            fits = self.rule.fits(self.held, at)
            if not fits:
                return fits, n
            at += self.rule.size(self.held, at)
            if at > len(self.held):
                return None, n + 1
        return True, CHAIN

    def _begin(self) -> int | None:
        """Where the records begin. Any record of the true chain will do: those before it go to ``head``."""
        if self.first:
            while (at := self.rule.header(self.held)) is None:
                if not self._more():
                    return None
            return at
        undecided, tried = [], 0
        while self._more():
            places, undecided = [*undecided, *range(tried, len(self.held))], []
            tried = len(self.held)
            for at in places:
                found, _ = self._chain(at)
                if found:
                    return at
                if found is None:
                    undecided.append(at)
        # No whole chain is left: the longest that goes on to the split's end must do.
        best = max(undecided, key=lambda at: (self._chain(at)[1], -at), default=None)
        return best if best is not None and self._chain(best)[1] else None

    def runs(self) -> Iterator[tuple[bytearray, list[int]]]:
        """The buffer, the places of the whole records in it and the last one's end, which hold until the next ones are asked for."""
        at = self._begin()
        if at is None:
            self.head = bytes(self.held)
            return
        self.begun, self.head = True, bytes(self.held[:at])
        while True:
            edges = [at]
            while (size := self.rule.size(self.held, at)) is not None and at + size <= len(self.held):
                at += size
                edges.append(at)
            if len(edges) > 1:
                yield self.held, edges
            del self.held[:at]
            at, left = 0, len(self.held)
            while len(self.held) < left + RUN and self._more():
                pass
            if len(self.held) == left:
                break
        self.tail = bytes(self.held)

    def records(self) -> Iterator[tuple[bytearray, int, int]]:
        """The buffer and the place of each whole record in it, which holds until the next one is asked for."""
        for held, edges in self.runs():
            for at, end in zip(edges, edges[1:]):
                yield held, at, end


def close(seams: Iterable[tuple[bool, bytes, bytes]], rule: Rule) -> tuple[bytes, list[bytes]]:
    """A file's header and the records that its borders cut, from (begun, head, tail) of its splits in order."""
    header, cut, carry = None, [], b""
    for begun, head, tail in [*seams, (True, b"", b"")]:
        carry += head
        if not begun:
            continue
        at = 0
        if header is None:
            if (at := rule.header(carry)) is None:
                raise ValueError("the header is cut off")
            header = carry[:at]
        while at < len(carry):
            size = rule.size(carry, at)
            if size is None or at + size > len(carry):
                raise ValueError("a record is cut off, or looks like several: spark.sql.files.maxPartitionBytes must exceed the file's size")
            cut.append(carry[at : at + size])
            at += size
        carry = tail
    return header, cut


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, data``: compressed blocks in order, ``block`` being the place where their split begins."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def _splits(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[str, int, Split]]:
    # One block is copied at a time, and no batch is held while the next one comes.
    def blocks() -> Iterator[tuple[str, int, bytes]]:
        for batch in batches:
            columns, batch, values = batch.columns, None, None
            for values in zip(*columns):
                yield tuple(v.as_py() for v in values)
            columns = values = None

    rows = blocks()

    def inflated(group: Iterator[tuple], first: bool) -> Iterator[bytes]:
        for n, (_, _, data) in enumerate(group):
            if n or not first:
                data = SEPARATOR + data  # before the file's first block nothing was cut off
            if data:
                yield BlockReader(data).read()

    for (file, block), group in groupby(rows, key=lambda r: r[:2]):
        yield file, block, Split(inflated(group, block == 0), rule, block == 0)


def _written_seams(raw: DataFrame, rule: Rule) -> DataFrame:
    """``file, header, record``: one row with the kept header for each file, one for each record that a border cuts.

    A file's heads and tails, parts of a record for each split, meet in one task.
    """

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, split in _splits(batches, rule):
            for _ in split.runs():
                pass
            row = {"file": file, "block": block, "begun": split.begun, "head": split.head, "tail": split.tail}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("block", pa.int64()), ("begun", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary())]))

    def closed(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        header, cut = close(((r["begun"], r["head"], r["tail"]) for r in rows), rule)
        n = len(cut) + 1
        return pa.table({"file": pa.array([rows[0]["file"]] * n, pa.string()), "header": pa.array([rule.kept(header)] + [None] * len(cut), pa.binary()), "record": pa.array([None, *cut], pa.binary())})

    spark = raw.sparkSession
    path = scratch.new_path(spark, "seams")
    raw.mapInArrow(seams, _SEAMS).groupBy("file").applyInArrow(closed, "file string, header binary, record binary").write.parquet(path)
    return spark.read.parquet(path)


def _scans(headers: DataFrame) -> Iterator[tuple[dict[str, int], list[bytes]]]:
    """Files with the number of their header, and these, for as many files as ``HEADERS`` allows at once; equal headers count once."""
    files: dict[str, int] = {}
    known: dict[bytes, int] = {}
    held = 0
    for file, header in headers.orderBy("header", "file").toLocalIterator():
        header = bytes(header)
        if known and header not in known and held + len(header) > HEADERS:
            yield files, list(known)
            files, known, held = {}, {}, 0
        held += 0 if header in known else len(header)
        files[file] = known.setdefault(header, len(known))
    if files:
        yield files, list(known)


def read_records(spark: SparkSession, path: str, rule: Rule, parse: Callable[[bytes, list[int], Any], list[pa.Array]], schema: str, names: list[str]) -> DataFrame:
    """The records of all files, as ``parse`` makes columns of the bytes of some, their places and end, and what is known from their file's header.

    The files are inflated twice: at once, for the headers and for what borders cut, and by the result's own scan.
    """
    raw = raw_blocks(spark, path)
    seams = _written_seams(raw, rule)
    out = None
    scans = list(_scans(seams.where("header IS NOT NULL").select("file", "header")))
    for files, headers in scans or [({}, [])]:

        def rows(found: Iterator[tuple[str, bytes, list[int]]], files: dict[str, int] = files, headers: list[bytes] = headers) -> Iterator[pa.RecordBatch]:
            known: dict[int, Any] = {}
            for file, data, edges in found:
                number = files[file]
                if number not in known:
                    known[number] = rule.known(headers[number])
                yield pa.RecordBatch.from_arrays(parse(data, edges, known[number]), names)

        def inside(batches: Iterator[pa.RecordBatch], rows: Callable = rows) -> Iterator[pa.RecordBatch]:
            runs = ((file, *run) for file, _, split in _splits(batches, rule) for run in split.runs())
            yield from rows((file, bytes(held[edges[0] : edges[-1]]), [at - edges[0] for at in edges]) for file, held, edges in runs)

        def across(batches: Iterator[pa.RecordBatch], rows: Callable = rows) -> Iterator[pa.RecordBatch]:
            cut = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            yield from rows((file, record, [0, len(record)]) for file, record in cut)

        own = F.col("file").isin(list(files)) if len(scans) > 1 else F.lit(True)
        both = raw.where(own).mapInArrow(inside, schema).unionAll(seams.where(own & F.col("record").isNotNull()).select("file", "record").mapInArrow(across, schema))
        out = both if out is None else out.unionAll(both)
    return out


def one_by_one(parse: Callable[[bytes, Any], tuple], types: list[pa.DataType]) -> Callable[[bytes, list[int], Any], list[pa.Array]]:
    """A parser of many records out of one of a record's bytes."""

    def many(data: bytes, edges: list[int], known: Any) -> list[pa.Array]:
        rows = [parse(data[at:end], known) for at, end in zip(edges, edges[1:])]
        return [pa.array(c, t) for c, t in zip(zip(*rows), types)]

    return many


def read_headers(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    """``file, header``: what is kept of each file's header, which must end in the file's first split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, _, split in _splits(batches, rule):
            next(split.records(), None)
            if not split.begun:
                raise ValueError("the header is cut off, or longer than spark.sql.files.maxPartitionBytes")
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([rule.kept(split.head)], pa.binary())], ["file", "header"])

    return raw_blocks(spark, path).where("block = 0").mapInArrow(run, "file string, header binary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """A file for each partition out of its rows of one binary column, compressed blocks; the mark of a file's end follows each row."""
    mark = deflate_block(b"").decode("latin-1")
    blocks.select(F.col(blocks.columns[0]).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", mark).text(path)


def number(data: bytes, at: int) -> int | None:
    """The 32-bit number at a place, None if it isn't all there."""
    return struct.unpack_from("<i", data, at)[0] if at + 4 <= len(data) else None
