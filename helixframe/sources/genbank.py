"""GenBank flat files: one row a record, features nested."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "locus string, length bigint, molecule_type string, topology string, division string, date string, definition string, accession string, version string, "
    "keywords array<string>, organism string, taxonomy array<string>, features array<struct<key:string,location:string,qualifiers:array<struct<k:string,v:string>>>>, sequence string"
)
_WORDS = pa.list_(pa.string())
_FEATURE = pa.struct([("key", pa.string()), ("location", pa.string()), ("qualifiers", pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))])
_FIELDS = pa.schema([("locus", pa.string()), ("length", pa.int64()), *[(c, pa.string()) for c in ("molecule_type", "topology", "division", "date", "definition", "accession", "version")], ("keywords", _WORDS), ("organism", pa.string()), ("taxonomy", _WORDS), ("features", pa.list_(_FEATURE)), ("sequence", pa.string())])


def _items(text: str) -> list[str]:
    """Entries between semicolons, without a closing dot."""
    return [x for x in (p.strip() for p in text.strip().rstrip(".").split(";")) if x]


def read_feature(block: str) -> dict | None:
    """``key location`` and ``/name="value"`` lines. What follows on other lines is added to the location, as it always was."""
    first, *rest = block.split("\n")
    key, *place = first.split()
    if not place:
        return None
    location, qualifiers = [" ".join(place)], []
    for line in map(str.strip, rest):
        if line.startswith("/"):
            name, _, value = line[1:].partition("=")
            qualifiers.append({"k": name, "v": value.strip('"')})
        elif line:
            location.append(line)
    return {"key": key, "location": " ".join(location), "qualifiers": qualifiers}


def read_record(text: str) -> dict:
    """One record's columns from its text without the closing ``//``; a bad LOCUS line is an error."""
    text = text.replace("\r", "")
    found = {s.split(None, 1)[0]: s for s in re.split(r"\n(?=\S)", text.strip("\n")) if s.strip()}
    locus = found.get("LOCUS", "").split("\n")[0].split()
    if len(locus) < 7 or not locus[2].isdigit():
        raise ValueError(f"bad LOCUS line: {' '.join(locus)}")

    def said(name: str) -> str:
        return " ".join(found.get(name, name).split()[1:])

    organism, *lineage = re.split(r"\n {2}ORGANISM\s+", found.get("SOURCE", "") + "\n")[-1].split("\n") if "ORGANISM" in found.get("SOURCE", "") else ["", ""]
    blocks = re.split(r"\n {5}(?=\S)", found.get("FEATURES", ""))[1:]
    letters = found.get("ORIGIN", "").split("\n")[1:]
    return {
        "locus": locus[1], "length": int(locus[2]), "molecule_type": locus[4], "topology": locus[5], "division": locus[6], "date": locus[7] if len(locus) > 7 else "",
        "definition": said("DEFINITION"), "accession": said("ACCESSION"), "version": said("VERSION"), "keywords": _items(said("KEYWORDS")),
        "organism": organism.strip(), "taxonomy": _items(" ".join(x.strip() for x in lineage)),
        "features": [f for f in map(read_feature, blocks) if f], "sequence": "".join(w for x in letters for w in x.lower().split() if not w.isdigit()),
    }


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Records are cut at ``//`` lines by the text reader, which can split a file between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_record(x.as_py()) for x in batch.column(0) if x.as_py().strip("/\r\n ")]
            yield pa.RecordBatch.from_pylist(found, _FIELDS)

    return spark.read.option("lineSep", "\n//").text(path).mapInArrow(run, SCHEMA)
