"""Binary alignments with the columns of ``read_sam``, and the bin indexes of block-compressed files."""

from __future__ import annotations

import array
import io
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import alignment as A
from helixframe.sources import bam_arrays, splits
from helixframe.sources.bam_arrays import BASES, OPS
from helixframe.sources.bgzf import BLOCK, BlockReader, deflate_block

SCHEMA = "name string, flags int, reference string, position int, mapq int, cigar string, mate_reference string, mate_position int, template_length int, sequence string, quality string, tags map<string,string>"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
_NAMES = [c.split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
# Struct codes of tag types.
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
_NUMBER = struct.Struct("<i")
#: Records of a batch that are written at once.
_MANY = 10_000
_PAIRS = [a + b for a in BASES for b in BASES]


def read_header(source: BlockReader | io.BytesIO) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (name, length) of the references."""
    if source.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", source.read(4))[0]
    text = source.read(number()).rstrip(b"\0").decode()
    return text, [(source.read(number())[:-1].decode(), number()) for _ in range(number())]


def _value(v: float, kind: str) -> str:
    return str(np.float32(v)) if kind == "f" else str(v)


def read_tag(data: bytes, at: int) -> tuple[str, str, int]:
    """The tag at a place, its ``type:value``, integers of any width as ``i``, and where it ends."""
    tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
    at += 3
    if kind == "A":
        return tag, "A:" + chr(data[at]), at + 1
    if kind in "ZH":
        end = data.index(0, at)
        return tag, f"{kind}:{data[at:end].decode()}", end + 1
    if kind == "B":
        of, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
        values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
        return tag, "B:" + ",".join([of, *(_value(v, of) for v in values)]), at + 5 + n * struct.calcsize(NUMBERS[of])
    if kind in NUMBERS:
        v = struct.unpack_from("<" + NUMBERS[kind], data, at)[0]
        return tag, ("f:" if kind == "f" else "i:") + _value(v, kind), at + struct.calcsize(NUMBERS[kind])
    raise ValueError(f"unknown tag type {kind}")


def read_tags(data: bytes) -> dict[str, str]:
    """Tags as ``type:value``; a repeated tag is an error."""
    at, out = 0, {}
    while at < len(data):
        tag, text, at = read_tag(data, at)
        if tag in out:
            raise ValueError(f"tag {tag} is repeated")
        out[tag] = text
    return out


def read_record(data: bytes, names: list[str]) -> tuple:
    """One record's columns. A cigar too long for its field comes from the CG tag; absent values are null."""
    ref, pos, l_name, mapq, _, n_ops, flags, l_seq, mate, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    sequence = "".join(_PAIRS[b] for b in data[at : at + (l_seq + 1) // 2])[:l_seq]
    at += (l_seq + 1) // 2
    quality = data[at : at + l_seq]
    tags = read_tags(data[at + l_seq :])
    cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in ops)
    if n_ops == 2 and cigar.startswith(f"{l_seq}S") and cigar.endswith("N") and tags.get("CG", "").startswith("B:I"):
        cigar = "".join(f"{int(v) >> 4}{OPS[int(v) & 15]}" for v in tags.pop("CG").split(",")[1:])
    scores = None if not l_seq or quality[0] == 255 else bytes(q + 33 for q in quality).decode()
    where = lambda i: names[i] if i >= 0 else None
    some = lambda p: p if p >= 0 else None
    return name, flags, where(ref), some(pos), None if mapq == 255 else mapq, cigar or "*", where(mate), some(mate_pos), size, sequence or None, scores, list(tags.items())


def read_many(data: bytes, edges: list[int], names: list[str]) -> list[pa.Array]:
    """The columns of records that follow one another with their sizes, from their places and the last one's end."""
    try:
        return bam_arrays.read(data, edges, names, read_tag)
    except (bam_arrays.Unusual, struct.error, IndexError, KeyError):
        rows = [read_record(data[at + 4 : end], names) for at, end in zip(edges, edges[1:])]
        return [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]


def records(source: BlockReader, names: list[str], end: int | None = None) -> Iterator[tuple]:
    """Records from here to the file's end, or those that start before the virtual offset ``end``."""
    while end is None or source.tell() < end:
        head = source.read(4)
        if not head:
            return
        size = struct.unpack("<i", head)[0] if len(head) == 4 else -1
        data = source.read(max(size, 0))
        if size < 32 or len(data) < size:
            raise ValueError("a record is cut off")
        yield read_record(data, names)


def _header_size(data: bytes) -> int | None:
    if len(data) >= 4 and data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = splits.number(data, 4)
    at = None if text is None else 12 + text
    for _ in range((None if at is None else splits.number(data, at - 4)) or 0):
        name = splits.number(data, at)
        if name is None:
            return None
        at += 8 + name
    return at if at is not None and at <= len(data) else None


def _record_size(data: bytes, at: int) -> int | None:
    if at + 4 > len(data):
        return None
    (size,) = _NUMBER.unpack_from(data, at)
    if size < 32:
        raise ValueError("a record is cut off")
    return 4 + size


def _fits(data: bytes, at: int) -> bool | None:
    """Whether a record can begin here: its lengths agree, and its name is printable and closed where they say."""
    if at + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if size < 32 or not l_name or min(ref, pos, mate, mate_pos) < -1 or l_seq < 0 or 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size:
        return False
    name = data[at + 36 : at + 36 + l_name]
    if len(name) < l_name:
        return None
    held = min(n_ops, (len(data) - at - 36 - l_name) // 4)
    ops = struct.unpack_from(f"<{held}I", data, at + 36 + l_name)
    return name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) and all(v & 15 < len(OPS) for v in ops)


def _references(kept: bytes) -> list[tuple[str, int]]:
    return read_header(io.BytesIO(b"BAM\x01\0\0\0\0" + kept))[1]


RULE = splits.Rule(_header_size, _record_size, _fits, lambda header: header[8 + splits.number(header, 4) :], lambda kept: [n for n, _ in _references(kept)])


def read_bam(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, index: BinIndex | None = None) -> DataFrame:
    """Alignment records with the columns of ``read_sam``.

    Files are read by many tasks, block by block. With ``region`` (reference, start, end) only reads that overlap it come;
    with the index of one file, of 2 GB at most, one task decompresses its chunks alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                source = BlockReader(content.as_py())
                names = [n for n, _ in read_header(source)[1]]
                chunks = index.query(names.index(region[0]), *region[1:]) if region[0] in names else []
                found = (r for begin, end in chunks if source.seek(begin) is None for r in records(source, names, end))
                while part := list(islice(found, 5000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), _TYPES)], _NAMES)

    if region and index:
        out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)
    else:
        out = splits.read_records(spark, path, RULE, read_many, SCHEMA, _NAMES)
    if region:
        name, start, end = region
        covered = A.cigar_length(A.parse_cigar(F.col("cigar")))
        out = out.where((F.col("reference") == name) & (F.col("position") < end) & (covered > 0) & (F.col("position") + covered > start))
    return out


def bam_references(spark: SparkSession, path: str) -> DataFrame:
    """``name, length`` of each reference in the files' headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept in batch.column("header"):
                found = _references(kept.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], ["name", "length"])

    return splits.read_headers(spark, path, RULE).mapInArrow(run, "name string, length bigint")


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
    return 0


def write_tags(tags: dict[str, str]) -> bytes:
    out = b""
    for tag, text in sorted(tags.items()):
        kind, value = text[0], text[2:]
        if kind == "B":
            of, *values = value.split(",")
            data = of.encode() + struct.pack(f"<I{len(values)}{NUMBERS[of]}", len(values), *(float(v) if of == "f" else int(v) for v in values))
        elif kind in "ZH":
            data = value.encode() + b"\0"
        elif kind == "A":
            data = value.encode()
        elif kind == "i" and int(value) > 0x7FFFFFFF:
            kind, data = "I", struct.pack("<I", int(value))
        else:
            data = struct.pack("<" + NUMBERS[kind], float(value) if kind == "f" else int(value))
        out += tag.encode() + kind.encode() + data
    return out


def write_record(row: dict, ids: dict[str, int]) -> bytes:
    """One record; a sequence and a quality of different lengths, or a reference that isn't in the header, are errors."""
    cigar = [(int(c[:-1]) << 4 | OPS.index(c[-1]), int(c[:-1]), c[-1]) for c in _split_cigar(row["cigar"])]
    seq, qual, tags = row["sequence"] or "", row["quality"], dict(row["tags"] or {})
    if qual is not None and len(qual) != len(seq):
        raise ValueError("sequence and quality differ in length")
    pos = -1 if row["position"] is None else row["position"]
    covered = sum(n for _, n, op in cigar if op in "MDN=X")
    ops = [v for v, _, _ in cigar]
    if len(ops) > 0xFFFF:
        tags["CG"] = "B:I," + ",".join(map(str, ops))
        ops = [len(seq) << 4 | 4, covered << 4 | 3]
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    name = row["name"].encode() + b"\0"
    which = lambda n: -1 if n is None else ids[n]
    fixed = struct.pack("<iiBBHHHiiii", which(row["reference"]), pos, len(name), 255 if row["mapq"] is None else row["mapq"], bin_of(pos, pos + max(covered, 1)) if pos >= 0 else 4680, len(ops), row["flags"], len(seq), which(row["mate_reference"]), -1 if row["mate_position"] is None else row["mate_position"], row["template_length"] or 0)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    scores = b"\xff" * len(seq) if qual is None else bytes(ord(q) - 33 for q in qual)
    data = fixed + name + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + write_tags(tags)
    return struct.pack("<i", len(data)) + data


def write_many(batch: pa.RecordBatch, ids: dict[str, int]) -> bytes:
    """The records of a batch, one after another."""
    try:
        return bam_arrays.written(batch, ids, _split_cigar, write_tags)
    except bam_arrays.Unusual:
        return b"".join(write_record(row, ids) for row in batch.to_pylist())


def _split_cigar(cigar: str | None) -> list[str]:
    if cigar in (None, "", "*"):
        return []
    cut = "".join(c + " " if c in OPS else c for c in cigar).split()
    if not all(c[:-1].isdigit() for c in cut):
        raise ValueError(f"bad cigar {cigar}")
    return cut


def bam_blocks(df: DataFrame, references: list[tuple[str, int]], level: int = 6) -> DataFrame:
    """``block``: the rows in order as compressed blocks, made where the rows are."""
    ids = {n: i for i, (n, _) in enumerate(references)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in batches:
            for at in range(0, batch.num_rows, _MANY):
                held += write_many(batch.slice(at, _MANY), ids)
                while len(held) >= BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array([deflate_block(bytes(held[:BLOCK]), level)], pa.binary())], ["block"])
                    del held[:BLOCK]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([deflate_block(bytes(held), level)], pa.binary())], ["block"])

    return df.select(*_NAMES).mapInArrow(run, "block binary")


def block_records(blocks: DataFrame, references: list[tuple[str, int]]) -> DataFrame:
    """Alignment records out of ``block``, in the order in which ``bam_blocks`` made them; a partition's are inflated one by one, and read some at a time."""
    names = [n for n, _ in references]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def whole() -> pa.RecordBatch | None:
            edges = [0]
            while len(held) - edges[-1] >= 4 and len(held) >= (end := edges[-1] + 4 + struct.unpack_from("<i", held, edges[-1])[0]):
                if end < edges[-1] + 36:
                    raise ValueError("a record is cut off")
                edges.append(end)
            out = pa.RecordBatch.from_arrays(read_many(bytes(held[: edges[-1]]), edges, names), _NAMES) if edges[1:] else None
            del held[: edges[-1]]
            return out

        wanted = splits.RUN
        for batch in batches:
            for block in batch.column(0):
                held += BlockReader(block.as_py()).read()
                if len(held) >= wanted:
                    if found := whole():
                        yield found
                    wanted = len(held) + splits.RUN
        if found := whole():
            yield found
        if held:
            raise ValueError("a record is cut off")

    return blocks.select("block").mapInArrow(run, SCHEMA)


def header_blocks(references: list[tuple[str, int]], text: str | None = None) -> bytes:
    """The compressed header; without ``text`` it lists the references."""
    text = "".join(f"@SQ\tSN:{n}\tLN:{s}\n" for n, s in references) if text is None else text
    head = b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(references))
    head += b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in references)
    return b"".join(deflate_block(head[at : at + BLOCK]) for at in range(0, len(head), BLOCK))


def write_bam_files(df: DataFrame, references: list[tuple[str, int]], path: str, text: str | None = None) -> None:
    """A file for each partition, written where its rows are, at any path that Spark writes; a task that is repeated writes its file anew."""
    head = header_blocks(references, text)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary())], ["block"])
        yield from batches

    splits.write_blocks(bam_blocks(df, references).mapInArrow(headed, "block binary"), path)


def write_bam(df: DataFrame, references: list[tuple[str, int]], path: str, text: str | None = None) -> None:
    """One file on the driver's disk, for export: blocks come partition by partition, so that one partition's are held."""
    with open(path, "wb") as f:
        f.write(header_blocks(references, text))
        for row in bam_blocks(df, references).toLocalIterator():
            f.write(row.block)
        f.write(deflate_block(b""))


class BinIndex:
    """Chunks of virtual offsets by reference and bin; ``kind`` is BAI, TBI or CSI."""

    def __init__(self, kind: str, shift: int, depth: int, names: list[str]):
        self.kind, self.shift, self.depth, self.names = kind, shift, depth, names
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.floors: list[array.array | dict[int, int]] = []

    def bins_of(self, start: int, end: int) -> list[int]:
        """Bins of all levels that can hold what overlaps [start, end)."""
        out, first = [], 0
        for level in range(self.depth + 1):
            by = self.shift + 3 * (self.depth - level)
            out += range(first + (start >> by), first + ((end - 1) >> by) + 1)
            first += 8**level
        return out

    def _floor(self, which: int, start: int) -> int:
        """Virtual offset before which nothing reaches ``start``."""
        floors = self.floors[which]
        if self.kind != "CSI":
            return floors[min(start >> self.shift, len(floors) - 1)] if floors else 0
        place = (8**self.depth - 1) // 7 + (start >> self.shift)
        while place and place not in floors:
            place = (place - 1) >> 3
        return floors.get(place, 0)

    def query(self, reference: int | str, start: int, end: int) -> list[tuple[int, int]]:
        """Merged chunks in order. A reference that isn't indexed has none, but is an error for TBI, as is an empty region."""
        which = self.names.index(reference) if reference in self.names else reference
        if not isinstance(which, int) or not 0 <= which < len(self.bins):
            if self.kind == "TBI":
                raise ValueError(f"no reference {reference}")
            return []
        start, end = max(start, 0), min(end, 1 << (self.shift + 3 * self.depth))
        if start >= end:
            if self.kind == "TBI":
                raise ValueError("start must be below end")
            return []
        floor, own, out = self._floor(which, start), self.bins[which], []
        for begin, stop in sorted(c for b in self.bins_of(start, end) for c in own.get(b, ()) if c[1] > floor or (self.kind == "BAI" and c[1] == floor)):
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], max(stop, out[-1][1]))
            else:
                out.append((begin, stop))
        return out


def parse_index(content: bytes) -> BinIndex:
    """A BAI, TBI or CSI file's content, compressed or not."""
    data = BlockReader(content).read() if content[:2] == b"\x1f\x8b" else content
    at = 4

    def take(form: str) -> tuple:
        nonlocal at
        got = struct.unpack_from("<" + form, data, at)
        at += struct.calcsize("<" + form)
        return got

    kind = {b"BAI\x01": "BAI", b"TBI\x01": "TBI", b"CSI\x01": "CSI"}.get(data[:4])
    if kind is None:
        raise ValueError("not an index")
    listed = lambda raw: [n.decode() for n in raw.split(b"\0") if n]
    shift, depth, names = 14, 5, []
    if kind == "CSI":
        shift, depth, size = take("3i")
        extra = data[at : at + size]
        names = listed(extra[28:]) if size > 28 else []
        at += size
    (n_ref,) = take("i")
    if kind == "TBI":
        *_, size = take("7i")
        names = listed(data[at : at + size])
        at += size
    out = BinIndex(kind, shift, depth, names)
    for _ in range(n_ref):
        bins, floors = {}, {}
        for _ in range(take("i")[0]):
            (number,) = take("I")
            if kind == "CSI":
                (floors[number],) = take("Q")
            flat = take(f"{2 * take('i')[0]}Q")
            bins[number] = list(zip(flat[::2], flat[1::2]))
        out.bins.append(bins)
        out.floors.append(floors if kind == "CSI" else array.array("Q", take(f"{take('i')[0]}Q")))
    return out


def read_index(spark: SparkSession, path: str) -> BinIndex:
    """The index file at any path that Spark reads; its size follows the references, not the reads."""
    return parse_index(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))


def region_lines(spark: SparkSession, path: str, index: BinIndex, reference: str, start: int, end: int) -> DataFrame:
    """``line``: lines of a block-compressed text file from the index's chunks; the caller filters them by position."""
    chunks = index.query(reference, start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                source = BlockReader(content.as_py())
                for begin, stop in chunks:
                    source.seek(begin)
                    held = b""
                    while source.tell() < stop:
                        there = source.at == stop >> 16 and source.used < len(source.held)
                        part = source.read((stop & 0xFFFF) - source.used if there else max(1, len(source.held) - source.used))
                        if not part:
                            break
                        *whole, held = (held + part).split(b"\n")
                        yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in whole], pa.string())], ["line"])
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([held.decode()], pa.string())], ["line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string").where("line <> ''")
