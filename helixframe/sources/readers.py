"""Text formats as DataFrames: one scan of lines, then column expressions. Malformed required fields are errors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.sequence import let


def _lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """Non-empty lines, right-trimmed; with ``comments`` those that start with ``#`` left out. Compressed files by extension."""
    line = F.rtrim("value", F.lit(" \t\n\v\f\r"))
    out = spark.read.text(path).select(line.alias("line")).where("line <> ''")
    return out.where(~F.col("line").startswith("#")) if comments else out


def _fields(spark: SparkSession, path: str, least: int, comments: bool = True) -> DataFrame:
    cols = F.split("line", "\t", -1)
    return _lines(spark, path, comments).select(F.when(F.size(cols) >= least, cols).otherwise(F.raise_error(F.concat(F.lit("too few columns: "), F.col("line")))).alias("c"))


def _at(i: int, kind: str = "string") -> Column:
    return F.col("c")[i].cast(kind)


def _opt(i: int, kind: str = "string") -> Column:
    x = F.try_element_at("c", F.lit(i + 1))
    return F.when(x != ".", x).cast(kind)


def _ordered(df: DataFrame) -> DataFrame:
    """Fails rows whose start isn't below their end."""
    return df.withColumn("end", F.when(F.col("start") < F.col("end"), F.col("end")).otherwise(F.raise_error(F.lit("start must be below end"))))


def read_bed(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    """BED with 3, 6 or 12 columns; further ones are ignored."""
    out = [_at(0).alias("chrom"), _at(1, "bigint").alias("start"), _at(2, "bigint").alias("end")]
    if columns >= 6:
        strand = F.when(_at(5).isin("+", "-", "."), _at(5)).otherwise(F.raise_error(F.lit("strand must be +, - or .")))
        out += [_opt(3).alias("name"), _opt(4, "bigint").alias("score"), strand.alias("strand")]
    if columns >= 12:
        numbers = lambda i: F.transform(F.split(_at(i), ","), lambda x: x.cast("bigint"))
        out += [_at(6, "bigint").alias("thick_start"), _at(7, "bigint").alias("thick_end"), _opt(8).alias("item_rgb"), _at(9, "int").alias("block_count"), numbers(10).alias("block_sizes"), numbers(11).alias("block_starts")]
    return _ordered(_fields(spark, path, columns).select(*out))


def read_narrowpeak(spark: SparkSession, path: str) -> DataFrame:
    """BED6 and signal, p, q, peak; -1 stands for none. ``peak_position`` is start plus offset."""
    value = lambda i, kind: F.when(_at(i, "double") >= 0, _at(i, kind))
    df = _fields(spark, path, 10).select(_at(0).alias("chrom"), _at(1, "bigint").alias("start"), _at(2, "bigint").alias("end"), _opt(3).alias("name"), _opt(4, "bigint").alias("score"), _at(5).alias("strand"), _at(6, "double").alias("signal_value"), value(7, "double").alias("p_value"), value(8, "double").alias("q_value"), value(9, "int").alias("peak"))
    return _ordered(df).withColumn("peak_position", F.col("start") + F.col("peak"))


def _last_wins(pairs: Column) -> Column:
    """Map of (key, value) pairs whose last value counts. The pairs are computed once, and searched by key only if one is repeated."""

    def made(p: Column) -> Column:
        keys = F.transform(p, lambda x: x["k"])
        last = lambda k: F.element_at(F.filter(p, lambda x: x["k"] == k), -1)["v"]
        repeated = F.map_from_arrays(F.array_distinct(keys), F.transform(F.array_distinct(keys), last))
        return F.when(F.size(F.array_distinct(keys)) == F.size(p), F.map_from_arrays(keys, F.transform(p, lambda x: x["v"]))).otherwise(repeated)

    return let(pairs, made)


def _split_pairs(text: Column, sep: str, mid: str) -> Column:
    parts = F.filter(F.transform(F.split(text, sep), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda x: F.when(F.instr(x, mid) > 0, F.trim(F.substr(x, F.instr(x, mid) + len(mid)))).otherwise("")
    return F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, mid, 1)).alias("k"), value(x).alias("v")))


def _feature_columns() -> list[Column]:
    return [_at(0).alias("seqid"), _at(1).alias("source"), _at(2).alias("feature"), _at(3, "bigint").alias("start"), _at(4, "bigint").alias("end"), _opt(5, "double").alias("score"), _at(6).alias("strand"), _opt(7, "int").alias("phase")]


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 9).select(*_feature_columns(), _last_wins(_split_pairs(F.col("c")[8], ";", "=")).alias("attributes"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id`` is required, ``transcript_id`` too unless the feature is a gene."""
    pairs = F.transform(_split_pairs(F.col("c")[8], ";", " "), lambda p: F.struct(p["k"].alias("k"), F.regexp_replace(p["v"], '^"|"$', "").alias("v")))
    df = _fields(spark, path, 9).select(*_feature_columns(), _last_wins(pairs).alias("attributes"))
    fine = F.col("attributes")["gene_id"].isNotNull() & ((F.col("feature") == "gene") | F.col("attributes")["transcript_id"].isNotNull())
    return df.withColumn("attributes", F.when(fine, F.col("attributes")).otherwise(F.raise_error(F.lit("gene_id or transcript_id is missing"))))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    alt = F.when(F.col("c")[4] == ".", F.array().cast("array<string>")).otherwise(F.split(F.col("c")[4], ","))
    info = F.when(F.col("c")[7] == ".", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(_last_wins(_split_pairs(F.col("c")[7], ";", "=")))
    return _fields(spark, path, 8).select(_at(0).alias("chrom"), _at(1, "bigint").alias("pos"), _opt(2).alias("id"), _at(3).alias("ref"), alt.alias("alt"), _opt(5, "double").alias("qual"), _opt(6).alias("filter"), info.alias("info"), _opt(8).alias("format"), F.slice("c", 10, 1 << 30).alias("samples"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header's column line."""
    found = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    return found[0].value.rstrip().split("\t")[9:] if found else []


def _tags(first: int) -> Column:
    return _last_wins(F.transform(F.filter(F.slice("c", first + 1, 1 << 30), lambda x: x.rlike("^[^:]+:[^:]+:")), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substr(x, F.instr(x, ":") + 1).alias("v"))))


def read_gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``headers``, ``segments``, ``links``, ``paths`` of an assembly graph: filtered views of one scan."""
    c = _fields(spark, path, 1, comments=False)
    kind = F.col("c")[0]
    length = F.when(F.col("c")[2] == "*", F.regexp_extract(F.array_join(F.filter("c", lambda x: x.startswith("LN:i:")), ""), r"(\d+)$", 1).try_cast("bigint")).otherwise(F.length(F.col("c")[2]))
    return {
        "headers": c.where(kind == "H").select(_tags(1).alias("tags")),
        "segments": c.where(kind == "S").select(_at(1).alias("name"), _at(2).alias("sequence"), length.cast("bigint").alias("length"), _tags(3).alias("tags")),
        "links": c.where(kind == "L").select(_at(1).alias("from_segment"), _at(2).alias("from_orient"), _at(3).alias("to_segment"), _at(4).alias("to_orient"), _at(5).alias("overlap"), _tags(6).alias("tags")),
        "paths": c.where(kind == "P").select(_at(1).alias("name"), F.split(F.col("c")[2], ",").alias("steps"), F.split(F.col("c")[3], ",").alias("overlaps")),
    }


def _typed(spec: str) -> list[Column]:
    return [_at(i, x.split(" ")[1]).alias(x.split(" ")[0]) for i, x in enumerate(spec.split(", "))]


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    spec = "query_name string, query_length bigint, query_start bigint, query_end bigint, strand string, target_name string, target_length bigint, target_start bigint, target_end bigint, num_matches bigint, alignment_length bigint, mapq int"
    strand = F.when(_at(4).isin("+", "-"), _at(4)).otherwise(F.raise_error(F.lit("strand must be + or -")))
    return _fields(spark, path, 12, comments=False).select(*[strand.alias("strand") if i == 4 else c for i, c in enumerate(_typed(spec))])


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Tabular matches, with or without comment lines."""
    spec = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
    return _fields(spark, path, 12).select(*_typed(spec))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 5).select(*_typed("name string, length bigint, offset bigint, line_bases int, line_width int"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, sequence``. Records are cut at a line's first ``>`` by the reader, which can split a file between them."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.substr("value", F.length(head) + 1), r"\s", "")
    return raw.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("id"), F.when(body != "", body).otherwise(F.raise_error(F.concat(F.lit("empty sequence: "), head))).alias("sequence"))


_PIECES = "file string, block bigint, nth bigint, part string, id string, sequence string, quality string"
_NAMES = [c.split(" ")[0] for c in _PIECES.split(", ")]
_PIECE_TYPES = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]


def _fastq_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Records by file, block and number in the block.

    Text is cut before every line that begins with ``@``. Such a line may also be a quality: what comes before it then has three
    lines, a ``head``, and the ``tail`` follows. The two are put together here unless a block ends between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth, head = None, 0, None
        for batch in batches:
            out = []
            for value, *at in zip(*(c.to_pylist() for c in batch.columns)):
                first = at != place
                if first:
                    if head:
                        out.append((*place, nth - 1, "head", *head, None))
                    place, nth, head = at, 0, None
                    if at[1] == 0:
                        if not value.strip():
                            continue
                        if not value.startswith("@"):
                            raise ValueError(f"a FASTQ record must begin with @: {value[:80]}")
                        value = value[1:]
                lines = value.split("\n")
                if len(lines) in (2, 5) and not lines[-1]:
                    lines.pop()  # the file's end
                lines = [x.removesuffix("\r") for x in lines]
                if len(lines) == 1 and (head or (first and at[1])):
                    out.append((*place, nth - 1, "whole", *head, "@" + lines[0]) if head else (*place, -1, "tail", None, None, lines[0]))
                    head = None
                    continue
                if head or len(lines) not in (3, 4) or not lines[2].startswith("+"):
                    raise ValueError(f"a FASTQ record is incomplete: {(head or lines)[0][:80]}")
                if len(lines) == 4:
                    out.append((*place, nth, "whole", lines[0].rstrip(), lines[1], lines[3]))
                else:
                    head = (lines[0].rstrip(), lines[1])
                nth += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE_TYPES)], _NAMES)
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*place, nth - 1, "head", *head, None), _PIECE_TYPES)], _NAMES)

    raw = spark.read.option("lineSep", "\n@").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return raw.mapInArrow(run, _PIECES)


def _fastq_records(spark: SparkSession, path: str) -> DataFrame:
    """All records with ``file, block, nth``. What a border of blocks cuts, two rows of a block at most, is put together by file."""
    pieces = _fastq_pieces(spark, path)
    in_file = Window.partitionBy("file").orderBy("block", "nth")
    cut = pieces.where("part <> 'whole'").select("*", F.lag("part").over(in_file).alias("before"), F.lead("part").over(in_file).alias("after"), F.lead("quality").over(in_file).alias("rest"))
    wrong = F.raise_error(F.lit("a FASTQ record is incomplete"))
    heads = cut.where(F.when(F.col("part") == "head", True).when(F.col("before") == "head", False).otherwise(wrong.cast("boolean")))
    # A file can end with the quality "@", of which the cut leaves nothing.
    rest = F.when(F.col("after") == "tail", F.col("rest")).when(F.col("after").isNull(), "").otherwise(wrong)
    whole = pieces.where("part = 'whole'").drop("part").unionByName(heads.withColumn("quality", F.concat(F.lit("@"), rest)).select(*[c for c in _NAMES if c != "part"]))
    fine = F.length("sequence") == F.length("quality")
    return whole.withColumn("id", F.when(fine, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("bad FASTQ record: "), F.col("id")))))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``id, sequence, quality``. A file that isn't compressed is read by many tasks; it is scanned twice, for records and for cut ones."""
    return _fastq_records(spark, path).select("id", "sequence", "quality")


def numbered_fastq(spark: SparkSession, path: str) -> DataFrame:
    """The same with ``nth``, the record's number from 0 over all files in the order of their paths."""
    records = _fastq_records(spark, path)
    blocks = records.groupBy("file", "block").agg(F.count("*").alias("n"))
    files = blocks.groupBy("file").agg(F.sum("n").alias("total")).select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("earlier"))
    upto = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = blocks.withColumn("upto", upto).join(files, "file").select("file", "block", (F.col("upto") + F.col("earlier")).alias("start"))
    return records.join(starts, ["file", "block"]).select((F.col("start") + F.col("nth")).alias("nth"), "id", "sequence", "quality")


def pair_fastq(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by position (``nth``); a record without a mate is an error."""
    joined = first.alias("a").join(second.alias("b"), "nth", "full_outer")
    checked = F.when(F.col("a.id").isNotNull() & F.col("b.id").isNotNull(), F.col("a.id")).otherwise(F.raise_error(F.lit("the files have different numbers of records")))
    return joined.select("nth", checked.alias("id1"), F.col("b.id").alias("id2"), F.col("a.sequence").alias("sequence1"), F.col("b.sequence").alias("sequence2"), F.col("a.quality").alias("quality1"), F.col("b.quality").alias("quality2"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records; positions from 0, absent values null, tags as ``type:value``. References keep their names."""
    c = _fields(spark, path, 1, comments=False).where(~F.col("c")[0].startswith("@"))
    place = lambda i: F.when(_at(i, "int") > 0, _at(i, "int") - 1)
    name = lambda i: F.when(F.col("c")[i] != "*", F.col("c")[i])
    mapq = F.when(_at(4, "int") != 255, _at(4, "int"))
    mate = F.when(F.col("c")[6] == "=", name(2)).otherwise(name(6))
    return c.select(_at(0).alias("name"), _at(1, "int").alias("flags"), name(2).alias("reference"), place(3).alias("position"), mapq.alias("mapq"), _at(5).alias("cigar"), mate.alias("mate_reference"), place(7).alias("mate_position"), _at(8, "int").alias("template_length"), name(9).alias("sequence"), name(10).alias("quality"), _tags(11).alias("tags"))


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """``name, length`` of the header's @SQ lines."""
    head = spark.read.text(path).where(F.col("value").startswith("@SQ"))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("bigint").alias("length"))
