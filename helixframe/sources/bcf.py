"""Binary variants with the columns of ``read_vcf``, and variant headers as tables."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import splits

SCHEMA = "chrom string, pos bigint, id string, ref string, alt array<string>, qual double, filter string, info map<string,string>, format string, samples array<string>"
_WORDS = pa.list_(pa.string())
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), _WORDS, pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), _WORDS]
_NAMES = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "samples"]
# Fixed values of the format: types by code, and the bits of a missing and of a closing value by type.
CODES = {1: "<i1", 2: "<i2", 3: "<i4", 5: "<f4", 7: "S1"}
ABSENT = {1: (-128, -127), 2: (-32768, -32767), 3: (-2147483648, -2147483647), 5: (0x7F800001, 0x7F800002)}


def dictionaries(text: str) -> tuple[dict[int, str], dict[int, str]]:
    """Names by number of the filters and fields (PASS is 0), and of the contigs; IDX sets a number."""
    words, contigs = {0: "PASS"}, {}
    for kind, body in re.findall(r"^##(FILTER|INFO|FORMAT|contig)=<(.*)>", text, re.M):
        name = re.search(r"(?:^|,)ID=([^,]+)", body)[1]
        number = re.search(r",IDX=(\d+)", body)
        own = contigs if kind == "contig" else words
        if name not in own.values() or number:
            own[int(number[1]) if number else max(own, default=-1) + 1] = name
    return words, contigs


class Typed:
    """Reads typed values one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def form(self) -> tuple[int, int]:
        """Type and number of values."""
        head, self.at = self.data[self.at], self.at + 1
        return head & 15, int(self.values(*self.form())[0]) if head >> 4 == 15 else head >> 4

    def values(self, kind: int, n: int) -> np.ndarray:
        if not kind:
            return np.zeros(0, np.int8)
        if kind not in CODES:
            raise ValueError(f"unknown value type {kind}")
        out = np.frombuffer(self.data, CODES[kind], n, self.at)
        self.at += out.nbytes
        return out

    def next(self) -> np.ndarray:
        return self.values(*self.form())


def shown(values: np.ndarray, kind: int, genotype: bool = False) -> str:
    """Values as VCF text: a dot for a missing one, nothing after a closing one."""
    if kind == 7:
        return values.tobytes().rstrip(b"\0").decode() or "."
    if not kind or not len(values):
        return ""
    missing, closing = ABSENT[kind]
    raw = (values.view("<u4") if kind == 5 else values).tolist()
    raw = raw[: raw.index(closing)] if closing in raw else raw
    if genotype:
        alleles = [("|" if v & 1 else "/", "." if v == missing or v >> 1 == 0 else str((v >> 1) - 1)) for v in raw]
        return "".join(sep + a for sep, a in alleles)[1:] or "."
    return ",".join("." if r == missing else str(v) for r, v in zip(raw, values)) or "."


def read_record(shared: bytes, own: bytes, words: dict[int, str], contigs: dict[int, str]) -> tuple:
    chrom, pos, _, qual, n_info, n_allele, packed = struct.unpack_from("<iiI4sHHI", shared)
    n_format, n_sample = packed >> 24, packed & 0xFFFFFF
    typed = Typed(shared)
    typed.at = 24
    name = shown(typed.next(), 7)
    alleles = [shown(typed.next(), 7) for _ in range(n_allele)]
    filters = [words[int(i)] for i in typed.next()]
    info = {}
    for _ in range(n_info):
        key = words[int(typed.next()[0])]
        kind, n = typed.form()
        info[key] = shown(typed.values(kind, n), kind)
    typed, keys, cells = Typed(own), [], [[] for _ in range(n_sample)]
    for _ in range(n_format):
        key = words[int(typed.next()[0])]
        kind, n = typed.form()
        keys.append(key)
        for cell in cells:
            cell.append(shown(typed.values(kind, n), kind, key == "GT") or ".")
    missing = struct.unpack("<I", qual)[0] == ABSENT[5][0]
    quality = None if missing else float(str(np.frombuffer(qual, "<f4")[0]))
    alt = [a for a in alleles[1:] if a != "."]
    return contigs[chrom], pos + 1, None if name == "." else name, alleles[0], alt, quality, ";".join(filters) or None, list(info.items()), ":".join(keys) or None, [":".join(c) for c in cells]


def _header_size(data: bytes) -> int | None:
    if len(data) >= 4 and data[:4] != b"BCF\x02":
        raise ValueError("not a BCF file")
    text = splits.number(data, 5)
    return 9 + text if text is not None and 9 + text <= len(data) else None


def _record_size(data: bytes, at: int) -> int | None:
    if at + 8 > len(data):
        return None
    shared, own = struct.unpack_from("<II", data, at)
    if shared < 24:
        raise ValueError("a record is cut off")
    return 8 + shared + own


def _fits(data: bytes, at: int) -> bool | None:
    """Whether a record can begin here: its numbers are in range, and its name and first allele are texts that fit."""
    if at + 33 > len(data):
        return None
    shared, own, chrom, pos, span, _, _, n_allele, packed = struct.unpack_from("<IIiii4sHHI", data, at)
    if not 24 < shared < 1 << 28 or own >= 1 << 30 or chrom < 0 or pos < -1 or span < 0 or (packed >> 24 == 0) != (own == 0):
        return False
    typed = Typed(data)
    typed.at = at + 32
    try:
        for _ in range(1 + min(n_allele, 1)):
            kind, n = typed.form()
            if kind != 7 or typed.at + n > at + 8 + shared:
                return False
            if not all(32 < c < 127 for c in data[typed.at : typed.at + n]):
                return False
            typed.at += n
    except IndexError:
        return None  # the name goes on after what is held
    except ValueError:
        return False
    return True


def _parse(record: bytes, known: tuple[dict[int, str], dict[int, str]]) -> tuple:
    end = 8 + struct.unpack_from("<I", record)[0]
    return read_record(record[8:end], record[end:], *known)


RULE = splits.Rule(_header_size, _record_size, _fits, lambda header: header[9:].rstrip(b"\0"), lambda text: dictionaries(text.decode()))


def read_bcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant records with the columns of ``read_vcf``; files are read by many tasks, and one that is cut off is an error."""
    return splits.read_records(spark, path, RULE, splits.one_by_one(_parse, _TYPES), SCHEMA, _NAMES)


def vcf_header(spark: SparkSession, path: str) -> DataFrame:
    """``kind, id, number, type, length, description, value`` of each ``##`` line of a VCF; unstructured ones have only kind and value."""
    line = spark.read.text(path).where(F.col("value").startswith("##")).select(F.regexp_extract("value", "^##([^=]*)=", 1).alias("kind"), F.regexp_extract("value", "^##[^=]*=(.*)$", 1).alias("value"))
    part = lambda key: F.nullif(F.regexp_extract("value", f"^<(?:.*,)?{key}=([^,>]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract("value", 'Description="([^"]*)"', 1), F.lit(""))
    structured = F.col("value").startswith("<")
    cells = {"id": part("ID"), "number": part("Number"), "type": part("Type"), "length": part("length").try_cast("bigint"), "description": quoted}
    return line.select("kind", *[F.when(structured, c).alias(n) for n, c in cells.items()], "value")
