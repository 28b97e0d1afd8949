"""Files on web servers: each task fetches a range of bytes, so that a file is spread over the cluster and none is held whole."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attempts at one request, and the seconds before the second one, which double.
ATTEMPTS, PAUSE = 3, 0.1
#: Bytes of one request, and of those beyond a range's end, where only a line's rest is missing.
STEP, REST = 4 << 20, 64 << 10
_TIMEOUT = 30


def _ask(request: urllib.request.Request) -> tuple[int, dict, bytes]:
    """Status, headers and body. Failing connections and servers are asked again; what a server refuses isn't."""
    for attempt in range(ATTEMPTS):
        if attempt:
            time.sleep(PAUSE * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(request, timeout=_TIMEOUT) as answer:
                # A whole file in place of a range isn't read.
                ranged = request.get_header("Range") is None or answer.status != 200
                return answer.status, dict(answer.headers), answer.read() if ranged else b""
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt + 1 == ATTEMPTS:
                return e.code, dict(e.headers), b""
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
    raise AssertionError("unreachable")


def fetch_range(url: str, start: int, end: int) -> bytes:
    """Bytes [start, end), fewer at the file's end; a server that doesn't answer with that range is an error."""
    status, _, body = _ask(urllib.request.Request(url, headers={"Range": f"bytes={start}-{end - 1}"}))
    if status == 416:
        raise ValueError(f"{url} has no bytes {start} to {end - 1}")
    if status != 206:
        raise ValueError(f"{url} was to answer with a range (206), not with {status}")
    if len(body) > end - start:
        raise ValueError(f"{url} answered with {len(body)} bytes for {end - start}")
    return body


def content_length(url: str) -> int:
    status, headers, _ = _ask(urllib.request.Request(url, method="HEAD"))
    length = {k.lower(): v for k, v in headers.items()}.get("content-length")
    if status != 200 or length is None:
        raise ValueError(f"{url} names no length (status {status})")
    return int(length)


def _pieces(url: str, at: int, end: int, size: int, packed: bool) -> Iterator[bytes]:
    """The bytes from ``at`` on, step by step, as far as the caller asks; gzip's members are inflated."""
    inflate = zlib.decompressobj(31) if packed else None
    while at < size:
        data = fetch_range(url, at, min(at + STEP, max(end, at + REST), size))
        if not data:
            raise ValueError(f"{url} ends at byte {at} of {size}")
        at += len(data)
        while inflate and data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if part := inflate.decompress(data, STEP):
                yield part
            data = inflate.unconsumed_tail or inflate.unused_data
        if not inflate:
            yield data
    if inflate and not inflate.eof:
        raise ValueError(f"{url} is cut off")


def range_lines(url: str, start: int, end: int, size: int, packed: bool = False) -> Iterator[bytes]:
    """Lines that begin in [start, end); the last one is read to its end."""
    place, skip, held = max(start - 1, 0), start > 0, b""
    for part in _pieces(url, place, end, size, packed):
        *whole, held = (held + part).split(b"\n")
        for line in whole:
            if not skip:
                yield line
            skip, place = False, place + len(line) + 1
            if place >= end and not packed:
                return
    if held and not skip:
        yield held


def http_lines(urls: DataFrame, chunk: int = 64 << 20) -> DataFrame:
    """``url, value``: the lines of the files that the column ``url`` names, without their ends; each url once, nulls left out.

    Lengths are asked and ranges of ``chunk`` bytes are read by tasks. A file in gzip can't be split and is read by one task, as a
    stream. A line of any length is held by the task in whose range it begins. A repeated task fetches its ranges again.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [content_length(u) for u in batch.column(0).to_pylist()]
            packed = [n > 1 and fetch_range(u, 0, 2) == b"\x1f\x8b" for u, n in zip(batch.column(0).to_pylist(), sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.bool_())], ["url", "size", "packed"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, n = [], 0
                for line in range_lines(row["url"], row["start"], row["end"], row["size"], row["packed"]):
                    held.append(line.removesuffix(b"\r").decode())
                    n += len(line)
                    if n > STEP:
                        yield pa.RecordBatch.from_arrays([pa.array([row["url"]] * len(held)), pa.array(held)], ["url", "value"])
                        held, n = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([row["url"]] * len(held)), pa.array(held)], ["url", "value"])

    known = urls.select("url").where("url IS NOT NULL").distinct().mapInArrow(lengths, "url string, size bigint, packed boolean").where("size > 0")
    step = F.when(F.col("packed"), F.col("size")).otherwise(F.lit(chunk).cast("bigint"))
    ranges = known.withColumn("step", step).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("step"))).alias("start"))
    spread = ranges.select("url", "size", "packed", "start", F.least(F.col("start") + F.col("step"), F.col("size")).alias("end")).repartition("url", "start")
    return spread.mapInArrow(lines, "url string, value string")
