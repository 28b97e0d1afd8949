"""Record lines of text formats as column expressions, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_lines(name: Column, seq: Column, width: int | None = 80) -> Column:
    """``>name`` and the sequence in lines of ``width``; an error for an empty name or sequence."""
    wrapped = seq if width is None else F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    return _guard(F.concat(F.lit(">"), name, F.lit("\n"), wrapped), (F.length(name) > 0) & (F.length(seq) > 0), "empty FASTA name or sequence")


def _guard(line: Column, valid: Column, message: str) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), line).otherwise(F.raise_error(F.lit(message)))


def fastq_lines(name: Column, seq: Column, qual: Column) -> Column:
    return _guard(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual), F.length(seq) == F.length(qual), "sequence and quality differ in length")


def bed_lines(*columns: Column) -> Column:
    """``chrom, start, end`` and any further columns; nulls become dots."""
    fields = [F.coalesce(c.cast("string"), F.lit(".")) for c in columns]
    return _guard(F.concat_ws("\t", *fields), (F.length(columns[0]) > 0) & (columns[1] < columns[2]), "BED rows need a chromosome and start < end")


# Features whose GTF lines need a transcript.
OF_TRANSCRIPTS = ("transcript", "exon", "CDS", "UTR", "start_codon", "stop_codon")


def feature_lines(df: DataFrame, gtf: bool = False) -> Column:
    """GFF3 or GTF lines with sorted attributes of ``seqid, source, feature, start, end, score, strand, phase, attributes``.

    GTF needs a ``gene_id``, and a ``transcript_id`` on the features of transcripts.
    """
    entry = (lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";'))) if gtf else (lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries(df["attributes"])), entry), " " if gtf else ";")
    score = F.when(df["score"].isNull(), ".").otherwise(F.format_string("%.2f", df["score"]))
    line = F.concat_ws("\t", df["seqid"], df["source"], df["feature"], df["start"].cast("string"), df["end"].cast("string"), score, df["strand"], F.coalesce(df["phase"].cast("string"), F.lit(".")), attributes)
    named = df["attributes"]["gene_id"].isNotNull() & (~df["feature"].isin(*OF_TRANSCRIPTS) | df["attributes"]["transcript_id"].isNotNull()) if gtf else F.lit(True)
    return _guard(line, (F.length(df["seqid"]) > 0) & (df["start"] > 0) & (df["start"] <= df["end"]) & (F.coalesce(df["phase"], F.lit(0)) <= 2) & named, "bad feature row")


#: Header of a GFF3 file.
GFF3_HEADER = ["##gff-version 3"]


def vcf_header_lines(samples: list[str] = [], info: dict[str, str] = {}, form: dict[str, str] = {}, filters: dict[str, str] = {}, contigs: dict[str, int | None] = {}, other: list[str] = [], version: str = "VCFv4.2") -> list[str]:
    """The version, definitions by kind and name, other lines and the line of columns."""
    out = [f"##fileformat={version}"]
    for kind, said in (("INFO", info), ("FORMAT", form), ("FILTER", filters)):
        out += [f'##{kind}=<ID={k},Description="{v}">' for k, v in sorted(said.items())]
    out += [f"##contig=<ID={k}>" if n is None else f"##contig=<ID={k},length={n}>" for k, n in sorted(contigs.items())]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [*out, *(f"##{x}" for x in other), "\t".join(columns)]


def sam_header_lines(references: list[tuple[str, int]]) -> list[str]:
    return ["@HD\tVN:1.6\tSO:unknown", *(f"@SQ\tSN:{n}\tLN:{size}" for n, size in references)]


def with_header(lines: DataFrame, header: list[str]) -> DataFrame:
    """The header as a partition before those of ``lines`` (one column), so that the files one after the other are one file."""
    spark: SparkSession = lines.sparkSession
    head = spark.createDataFrame([(x,) for x in header], f"`{lines.columns[0]}` string").coalesce(1)
    return head.union(lines)


def vcf_lines(df: DataFrame) -> Column:
    info = F.array_join(F.transform(F.array_sort(F.map_entries(df["info"])), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    dot = lambda c: F.coalesce(F.when(c != "", c), F.lit("."))
    qual = F.regexp_replace(df["qual"].cast("string"), r"\.0$", "")
    rest = F.when(df["format"].isNotNull(), F.concat(F.lit("\t"), df["format"], F.array_join(F.transform(df["samples"], lambda s: F.concat(F.lit("\t"), s)), ""))).otherwise("")
    return F.concat(F.concat_ws("\t", df["chrom"], df["pos"].cast("string"), dot(df["id"]), df["ref"], dot(F.array_join(df["alt"], ",")), dot(qual), dot(df["filter"]), dot(info)), rest)


def paf_lines(df: DataFrame) -> Column:
    return F.concat_ws("\t", *[df[c].cast("string") for c in df.columns[:12]])


def blast_lines(df: DataFrame) -> Column:
    """The identity with two decimals; e-values and scores as Spark prints them."""
    return F.concat_ws("\t", *[F.format_string("%.2f", df[c]) if c == "pident" else df[c].cast("string") for c in df.columns[:12]])


def fai_lines(df: DataFrame) -> Column:
    return F.concat_ws("\t", *[df[c].cast("string") for c in ("name", "length", "offset", "line_bases", "line_width")])


def _tag_fields(tags: Column) -> Column:
    """A tab and ``key:type:value`` for each tag, by key."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(tags)), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(":"), e["value"])), "")


def sam_lines(df: DataFrame) -> Column:
    """Alignment lines with reference names and positions from 1; absent values as the format writes them."""
    star = lambda c: F.coalesce(df[c], F.lit("*"))
    place = lambda c: (F.coalesce(df[c], F.lit(-1)) + 1).cast("string")
    mate = F.when(df["mate_reference"] == df["reference"], "=").otherwise(star("mate_reference"))
    line = F.concat_ws("\t", df["name"], df["flags"].cast("string"), star("reference"), place("position"), F.coalesce(df["mapq"], F.lit(255)).cast("string"), star("cigar"), mate, place("mate_position"), F.coalesce(df["template_length"], F.lit(0)).cast("string"), star("sequence"), star("quality"))
    valid = df["quality"].isNull() | (F.length(df["quality"]) == F.length(df["sequence"]))
    return _guard(F.concat(line, F.coalesce(_tag_fields(df["tags"]), F.lit(""))), valid, "sequence and quality differ in length")


def gfa_lines(segments: DataFrame, links: DataFrame, paths: DataFrame) -> DataFrame:
    """``line`` of a whole graph: header, segments, links, paths."""
    join = lambda *c: F.concat_ws("\t", *c)
    head = segments.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "line string")
    s = segments.select(F.concat(join(F.lit("S"), "name", F.coalesce("sequence", F.lit("*"))), _tag_fields(F.col("tags"))).alias("line"))
    one = links.select(F.concat(join(F.lit("L"), "from_segment", "from_orient", "to_segment", "to_orient", "overlap"), _tag_fields(F.col("tags"))).alias("line"))
    p = paths.select(join(F.lit("P"), "name", F.array_join("steps", ","), F.array_join("overlaps", ",")).alias("line"))
    return head.union(s).union(one).union(p)


def write_lines(df: DataFrame, line: Column, path: str, compression: str | None = None) -> None:
    """One text file per partition; with ``compression`` such as ``gzip``."""
    df.select(line.alias("value")).write.text(path, compression=compression or "none")
