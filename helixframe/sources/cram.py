"""Reference-compressed alignments (CRAM 3.0 and 3.1) with the columns of ``read_bam``.

Blocks may be raw, gzip, bzip2, lzma or in either range coder; name tokens, the adaptive coder and the quality model are errors.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import bam
from helixframe.sources.rans import Bytes, decode_4x8, decode_16

#: Bases of a piece of the reference that is joined to the slices.
CHUNK = 1 << 16
# Fixed values of the format: kinds of blocks and of encodings.
FILE_HEADER, COMPRESSION, SLICE, EXTERNAL, CORE = 0, 1, 2, 4, 5
E_NONE, E_EXTERNAL, E_HUFFMAN, E_LENGTH, E_STOP, E_BETA, E_SUBEXP, E_GAMMA = 0, 1, 3, 4, 5, 6, 7, 9
INFLATE: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: gzip.decompress, 2: bz2.decompress, 3: lzma.decompress, 4: decode_4x8}


def itf8(source: Bytes) -> int:
    """A 32-bit number in one to five bytes: the first one's leading bits tell how many follow."""
    first = source.byte()
    if first < 0x80:
        return first
    more = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
    rest = int.from_bytes(source.take(more), "big")
    value = (first & 15) << 28 | rest >> 8 << 4 | rest & 15 if more == 4 else (first & (0x7F >> more)) << 8 * more | rest
    return value - (1 << 32) if value >> 31 else value


def ltf8(source: Bytes) -> int:
    """A 64-bit number in one to nine bytes."""
    first = source.byte()
    more = next((i for i in range(8) if not first & 0x80 >> i), 8)
    value = (first & (0x7F >> more)) << 8 * more | int.from_bytes(source.take(more), "big")
    return value - (1 << 64) if value >> 63 else value


def itf8s(source: Bytes) -> list[int]:
    return [itf8(source) for _ in range(itf8(source))]


class Block(NamedTuple):
    kind: int
    number: int
    data: bytes


def read_block(source: Bytes) -> Block:
    """One block, inflated; a wrong checksum or length is an error."""
    start = source.at
    method, kind = source.byte(), source.byte()
    number, packed, size = itf8(source), itf8(source), itf8(source)
    data = source.take(packed)
    if zlib.crc32(source.data[start : source.at]) != source.word("I"):
        raise ValueError("a block's checksum is wrong")
    if method == 5:
        out = decode_16(data, size)
    elif method in INFLATE:
        out = INFLATE[method](data) if size else b""
    else:
        raise ValueError(f"blocks of method {method} can't be read")
    if len(out) != size:
        raise ValueError("a block's length is wrong")
    return Block(kind, number, out)


class Container(NamedTuple):
    reference: int
    start: int
    records: int
    marks: list[int]
    body: bytes


def containers(data: bytes) -> Iterator[Container]:
    """All containers, the first of which holds the header; a file without its closing container is cut off."""
    if data[:4] != b"CRAM" or data[4] != 3:
        raise ValueError("not a CRAM file of version 3")
    source = Bytes(data, 26)
    while source.at < len(data):
        begin = source.at
        size = source.word("i")
        reference, start, _, records = (itf8(source) for _ in range(4))
        ltf8(source), ltf8(source), itf8(source)
        marks = itf8s(source)
        if zlib.crc32(data[begin : source.at]) != source.word("I"):
            raise ValueError("a container's checksum is wrong")
        body = source.take(size)
        if reference == -1 and start == 4542278 and not records:
            return
        yield Container(reference, start, records, marks, body)
    raise ValueError("the file is cut off")


class Bits:
    """Reads bits, the highest of a byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def ones(self) -> int:
        """How many ones come before the next zero, which is read too."""
        n = 0
        while self.take(1):
            n += 1
        return n


class Streams:
    """The core and external blocks that a slice's values come from."""

    def __init__(self, blocks: list[Block]):
        self.core = Bits(next((b.data for b in blocks if b.kind == CORE), b""))
        self.outer = {b.number: Bytes(b.data) for b in blocks if b.kind == EXTERNAL}

    def of(self, number: int) -> Bytes:
        return self.outer.setdefault(number, Bytes(b""))


class Encoding:
    """How one series of values is stored."""

    def __init__(self, source: Bytes):
        self.kind = itf8(source)
        inner = Bytes(source.take(itf8(source)))
        if self.kind == E_EXTERNAL:
            self.number_ = itf8(inner)
        elif self.kind == E_HUFFMAN:
            symbols, lengths = itf8s(inner), itf8s(inner)
            code, before, self.codes = 0, 0, {}
            for length, symbol in sorted(zip(lengths, symbols)):
                code, before = code << length - before, length
                self.codes[length, code] = symbol
                code += 1
            self.lengths = sorted(set(lengths))
        elif self.kind == E_LENGTH:
            self.length, self.value = Encoding(inner), Encoding(inner)
        elif self.kind == E_STOP:
            self.stop, self.number_ = bytes([inner.byte()]), itf8(inner)
        elif self.kind in (E_BETA, E_SUBEXP):
            self.offset, self.bits = itf8(inner), itf8(inner)
        elif self.kind == E_GAMMA:
            self.offset = itf8(inner)
        elif self.kind != E_NONE:
            raise ValueError(f"encoding {self.kind} can't be read")

    def number(self, streams: Streams) -> int:
        if self.kind == E_EXTERNAL:
            return itf8(streams.of(self.number_))
        core = streams.core
        if self.kind == E_HUFFMAN:
            code, held = 0, 0
            for length in self.lengths:
                code, held = code << length - held | core.take(length - held), length
                if (length, code) in self.codes:
                    return self.codes[length, code]
            raise ValueError("no such code")
        if self.kind == E_BETA:
            return core.take(self.bits) - self.offset
        if self.kind == E_GAMMA:
            n = 0
            while not core.take(1):
                n += 1
            return (1 << n | core.take(n)) - self.offset
        if self.kind == E_SUBEXP:
            n = core.ones()
            return (core.take(self.bits) if not n else 1 << n + self.bits - 1 | core.take(n + self.bits - 1)) - self.offset
        raise ValueError(f"encoding {self.kind} holds no numbers")

    def byte(self, streams: Streams) -> int:
        return streams.of(self.number_).byte() if self.kind == E_EXTERNAL else self.number(streams) & 255

    def run(self, streams: Streams, n: int) -> bytes:
        """``n`` bytes, one by one."""
        return streams.of(self.number_).take(n) if self.kind == E_EXTERNAL else bytes(self.byte(streams) for _ in range(n))

    def text(self, streams: Streams) -> bytes:
        if self.kind == E_LENGTH:
            return self.value.run(streams, self.length.number(streams))
        if self.kind != E_STOP:
            raise ValueError(f"encoding {self.kind} holds no texts")
        source = streams.of(self.number_)
        out = source.take(source.data.index(self.stop, source.at) - source.at)
        source.at += 1
        return out


class Compression:
    """A container's preservation map and encodings. Without a map for it, names are kept, positions are differences and the reference is needed."""

    def __init__(self, data: bytes):
        source = Bytes(data)
        self.names = self.differences = self.reference = True
        self.tag_lines: list[list[bytes]] = [[]]
        self.bases: dict[int, bytes] = {}
        itf8(source)
        for _ in range(itf8(source)):
            key = source.take(2)
            if key == b"SM":
                for base, codes in zip(b"ACGTN", source.take(5)):
                    others = bytes(b"ACGTN".replace(bytes([base]), b""))
                    self.bases[base] = bytes(other for _, other in sorted((codes >> 6 - 2 * i & 3, other) for i, other in enumerate(others)))
            elif key == b"TD":
                lines = source.take(itf8(source)).split(b"\0")[:-1]
                self.tag_lines = [[line[i : i + 3] for i in range(0, len(line), 3)] for line in lines]
            else:
                setattr(self, {b"RN": "names", b"AP": "differences", b"RR": "reference"}[key], bool(source.byte()))
        itf8(source)
        self.series = {source.take(2).decode(): Encoding(source) for _ in range(itf8(source))}
        itf8(source)
        self.tags = {itf8(source).to_bytes(3, "big"): Encoding(source) for _ in range(itf8(source))}


def apply_features(features: list[tuple[str, int, Any]], length: int, bases: Callable[[int, int], bytes], substitutions: dict[int, bytes]) -> tuple[bytes, str, dict[int, int], int]:
    """Sequence, CIGAR, single scores by place and bases covered, from a read's differences in order.

    ``bases(offset, n)`` are the reference's from the read's position on; places of features count from 1.
    """
    sequence, ops, scores, covered = bytearray(), [], {}, 0

    def add(n: int, op: str) -> None:
        if n and ops and ops[-1][1] == op:
            ops[-1][0] += n
        elif n:
            ops.append([n, op])

    def same(n: int) -> None:
        nonlocal covered
        if n > 0:
            sequence.extend(bases(covered, n))
            covered += n
            add(n, "M")

    for code, place, value in features:
        if code not in "qQ":
            same(place - 1 - len(sequence))
        if code == "X":
            of = bases(covered, 1)[0]
            sequence.append(substitutions.get(of, substitutions[ord("N")])[value])
            covered += 1
            add(1, "M")
        elif code in "Bb":
            own = value if code == "b" else value[:1]
            sequence += own
            covered += len(own)
            add(len(own), "M")
            if code == "B":
                scores[place - 1] = value[1]
        elif code in "IiS":
            sequence += value
            add(len(value), code.upper())
        elif code in "DN":
            covered += value
            add(value, code)
        elif code in "HP":
            add(value, code)
        else:
            scores.update(enumerate(value, place - 1))
    same(length - len(sequence))
    return bytes(sequence), "".join(f"{n}{op}" for n, op in ops), scores, covered


class SliceHead(NamedTuple):
    reference: int
    start: int
    span: int
    records: int
    counter: int
    embedded: int
    digest: bytes


def slice_head(data: bytes) -> SliceHead:
    source = Bytes(data)
    reference, start, span, records = (itf8(source) for _ in range(4))
    counter, _, _, embedded = ltf8(source), itf8(source), itf8s(source), itf8(source)
    return SliceHead(reference, start, span, records, counter, embedded, source.take(16))


def read_slice(compression: bytes, data: bytes, bases: Callable[[int, int, int], bytes | None]) -> Iterator[dict]:
    """The records of one slice. ``bases(reference, start, n)`` may know nothing: the read then has N where it is like the reference."""
    kept, source = Compression(compression), Bytes(data)
    blocks = []
    while source.at < len(data):
        blocks.append(read_block(source))
    head = slice_head(blocks[0].data)
    streams, series = Streams(blocks[1:]), kept.series
    own = next((b.data for b in blocks[1:] if b.kind == EXTERNAL and b.number == head.embedded), None) if head.embedded >= 0 else None
    if own is None and kept.reference and head.reference >= 0 and head.span > 0 and any(head.digest):
        known = bases(head.reference, head.start - 1, head.span)
        if known is not None and hashlib.md5(known).digest() != head.digest:
            raise ValueError("the reference isn't the one that the reads were compressed with")

    def like(reference: int, position: int, offset: int, n: int) -> bytes:
        start = position + offset
        if own is not None:
            found = own[start - head.start + 1 : start - head.start + 1 + n].upper()
        else:
            found = bases(reference, start, n) or b""
        return found.ljust(n, b"N")

    number = lambda name: series[name].number(streams)
    byte = lambda name: series[name].byte(streams)
    value_of: dict[str, Callable[[], Any]] = {
        "B": lambda: bytes([byte("BA"), byte("QS")]), "X": lambda: byte("BS"), "I": lambda: series["IN"].text(streams), "i": lambda: bytes([byte("BA")]), "b": lambda: series["BB"].text(streams), "S": lambda: series["SC"].text(streams),
        "q": lambda: series["QQ"].text(streams), "Q": lambda: bytes([byte("QS")]), "D": lambda: number("DL"), "N": lambda: number("RS"), "H": lambda: number("HC"), "P": lambda: number("PD"),
    }
    out, later, at = [], {}, head.start
    for i in range(head.records):
        flags, stored = number("BF"), number("CF")
        reference = number("RI") if head.reference == -2 else head.reference
        length, step = number("RL"), number("AP")
        at = at + step if kept.differences else step
        row = {"reference": reference, "position": at - 1, "group": number("RG"), "name": None, "mate_reference": -1, "mate_position": -1, "template_length": 0, "mapq": 255}
        if kept.names:
            row["name"] = series["RN"].text(streams)
        if stored & 2:
            mate = number("MF")
            if not kept.names:
                row["name"] = series["RN"].text(streams)
            row |= {"mate_reference": number("NS"), "mate_position": number("NP") - 1, "template_length": number("TS")}
            flags |= (0x20 if mate & 1 else 0) | (0x8 if mate & 2 else 0)
        elif stored & 4:
            later[i] = i + number("NF") + 1
        line = kept.tag_lines[number("TL")]
        row["tags"] = b"".join(tag + kept.tags[tag].text(streams) for tag in line)
        scores: dict[int, int] = {}
        if not flags & 4:
            features, place = [], 0
            for _ in range(number("FN")):
                code = chr(byte("FC"))
                place += number("FP")
                features.append((code, place, value_of[code]()))
            row["sequence"], row["cigar"], scores, row["covered"] = apply_features(features, length, lambda offset, n, at=at, reference=reference: like(reference, at - 1, offset, n), kept.bases)
            row["mapq"] = number("MQ")
        else:
            row |= {"sequence": b"" if stored & 8 else series["BA"].run(streams, length), "cigar": "", "covered": 0}
        if stored & 8:
            row["sequence"] = b""
        quality = series["QS"].run(streams, length) if stored & 1 else bytes(scores.get(j, 0) for j in range(length)) if scores else b""
        row |= {"flags": flags, "quality": None if not quality or quality[0] == 255 else quality}
        out.append(row)
    _join_mates(out, later)
    for i, row in enumerate(out):
        row["name"] = (row["name"] or str(head.counter + row.get("first", i) + 1).encode()).decode()
    yield from out


def _join_mates(rows: list[dict], later: dict[int, int]) -> None:
    """Mates in one slice name each other by place only: their columns come from the reads of the template."""
    starts = set(later) - set(later.values())
    for first in starts:
        chain = [first]
        while chain[-1] in later:
            chain.append(later[chain[-1]])
        reads = [rows[i] for i in chain]
        placed = all(not r["flags"] & 4 for r in reads) and len({r["reference"] for r in reads}) == 1
        left, right = min(r["position"] for r in reads), max(r["position"] + r["covered"] for r in reads)
        leftmost = next(i for i, r in enumerate(reads) if r["position"] == left)
        for i, (row, mate) in enumerate(zip(reads, reads[1:] + reads[:1])):
            row |= {"mate_reference": mate["reference"], "mate_position": mate["position"], "first": first}
            row["flags"] |= (0x20 if mate["flags"] & 0x10 else 0) | (0x8 if mate["flags"] & 4 else 0)
            row["template_length"] = (right - left) * (1 if i == leftmost else -1) if placed else 0
            row["name"] = row["name"] or reads[0]["name"]


def _row(row: dict, references: list[str], groups: list[str]) -> tuple:
    tags = bam.read_tags(row["tags"])
    if 0 <= row["group"] < len(groups):
        tags["RG"] = "Z:" + groups[row["group"]]
    where = lambda i: references[i] if i >= 0 else None
    some = lambda p: p if p >= 0 else None
    quality = row["quality"] and bytes(min(q, 93) + 33 for q in row["quality"]).decode()
    return row["name"], row["flags"], where(row["reference"]), some(row["position"]), None if row["mapq"] == 255 else row["mapq"], row["cigar"] or "*", where(row["mate_reference"]), some(row["mate_position"]), row["template_length"], row["sequence"].decode() or None, quality, list(tags.items())


_SLICES = "file string, slice bigint, compression binary, data binary, references array<string>, groups array<string>, wants array<struct<name:string,chunk:bigint>>"
_SLICE_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("name", pa.string()), ("chunk", pa.int64())]))]
_SLICE_NAMES = ["file", "slice", "compression", "data", "references", "groups", "wants"]


def slices_of(data: bytes) -> Iterator[tuple[bytes, bytes, list[str], list[str], list[tuple[str, int]]]]:
    """Compression header, slice, names of references and read groups, and the pieces of the reference that it needs."""
    references, groups = [], []
    for n, container in enumerate(containers(data)):
        source = Bytes(container.body)
        if n == 0:
            text = read_block(source).data
            lines = text[4 : 4 + struct.unpack_from("<i", text)[0]].decode().split("\n")
            named = lambda kind, key: [m[1] for x in lines if x.startswith(kind) and (m := re.search(rf"\t{key}:([^\t]+)", x))]
            references, groups = named("@SQ", "SN"), named("@RG", "ID")
            continue
        if not container.records:
            continue
        compression = read_block(source).data
        for begin, end in zip(container.marks, [*container.marks[1:], len(container.body)]):
            part = container.body[begin:end]
            wants: set[tuple[str, int]] = set()
            head = slice_head(read_block(Bytes(part)).data)
            if Compression(compression).reference and head.embedded < 0 and head.reference != -1:
                spans = [(head.reference, head.start - 1, head.span)]
                if head.reference == -2:
                    spans = [(r["reference"], r["position"], r["covered"]) for r in read_slice(compression, part, lambda *_: None)]
                wants = {(references[r], c) for r, start, span in spans if r >= 0 and span > 0 for c in range(max(start, 0) // CHUNK, (start + span - 1) // CHUNK + 1)}
            yield compression, part, references, groups, sorted(wants)


def reference_pieces(reference: DataFrame) -> DataFrame:
    """``name, chunk, bases`` in upper case out of ``id, sequence``, as ``read_fasta`` gives them; an id's first word is the name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sequence in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, len(sequence), CHUNK):
                    yield pa.RecordBatch.from_pylist([{"name": name.split()[0], "chunk": at // CHUNK, "bases": sequence[at : at + CHUNK].upper().encode()}])

    return reference.select("id", "sequence").mapInArrow(run, "name string, chunk bigint, bases binary")


def read_cram(spark: SparkSession, path: str, reference: DataFrame | None = None) -> DataFrame:
    """Alignment records with the columns of ``read_bam``; reads whose bases are the reference's hold N without it.

    A file, of 2 GB at most, is cut into its slices by one task; slices are spread over the cluster and joined to the pieces of
    the reference that they need, so that no task holds a whole genome; with a reference each file is cut twice, for these needs
    and for the slices. Scores that aren't stored beside stored ones are 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for n, (compression, part, references, groups, wants) in enumerate(slices_of(content.as_py())):
                    needed = [{"name": name, "chunk": chunk} for name, chunk in wants]
                    row = (file, n, compression, part, references, groups, needed)
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SLICE_TYPES)], _SLICE_NAMES)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pieces = {(p["name"], p["chunk"]): p["bases"] for p in row["pieces"] or []}

                def bases(which: int, start: int, n: int, row: dict = row, pieces: dict = pieces) -> bytes | None:
                    chunks = range(start // CHUNK, (start + n - 1) // CHUNK + 1)
                    found = [pieces.get((row["references"][which], c)) for c in chunks]
                    return None if None in found else b"".join(found)[start - chunks[0] * CHUNK :][:n]

                found = [_row(r, row["references"], row["groups"]) for r in read_slice(row["compression"], row["data"], bases)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), bam._TYPES)], bam._NAMES)

    slices = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(cut, _SLICES)
    if reference is None:
        whole = slices.repartition("file", "slice").withColumn("pieces", F.lit(None).cast("array<struct<name:string,chunk:bigint,bases:binary>>"))
    else:
        wants = slices.select("file", "slice", F.inline("wants"))
        pieces = wants.join(reference_pieces(reference), ["name", "chunk"]).groupBy("file", "slice").agg(F.collect_list(F.struct("name", "chunk", "bases")).alias("pieces"))
        whole = slices.join(pieces, ["file", "slice"], "left")
    return whole.select("compression", "data", "references", "groups", "pieces").mapInArrow(records, bam.SCHEMA)
