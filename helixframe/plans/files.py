"""Sources, sinks and streams as queries: each writes a view of whole tables as files, reads them again and describes the records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import alignment as A
from helixframe.functions import records as R
from helixframe.operators.derive import ALIGNMENTS, INTERVALS, READS, alignments, intervals, reads, table
from helixframe.sources import bam, columnar, fai, genbank, readers, scratch, writers
from helixframe.streaming import counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def stored(df: DataFrame, line: Column | str, name: str, header: list[str] | None = None) -> str:
    """The path of the files that hold these lines."""
    path = scratch.new_path(df.sparkSession, name)
    lines = df.select((F.col(line) if isinstance(line, str) else line).alias("value"))
    (writers.with_header(lines, header) if header else lines).write.text(path)
    return path


def _made(df: DataFrame, view: str) -> DataFrame:
    """A view in SQL over the table ``t``, which both engines understand."""
    return df.sparkSession.sql(view, t=df)


_text = lambda c: F.col(c).cast("string")


@query("fasta_file", f"WITH {READS} SELECT id::VARCHAR AS id, seq AS sequence FROM reads WHERE length(seq) > 0")
def _(spark, sf):
    df = reads(spark, sf).where("seq <> ''")
    return readers.read_fasta(spark, stored(df, writers.fasta_lines(_text("id"), F.col("seq")), "fasta"))


@query("fastq_file", f"WITH {READS} SELECT id::VARCHAR AS id, seq AS sequence, qual AS quality FROM reads")
def _(spark, sf):
    path = stored(reads(spark, sf), writers.fastq_lines(_text("id"), F.col("seq"), F.col("qual")), "fastq")
    return readers.read_fastq(spark, path)


@query("fasta_index", f"WITH {READS} SELECT id::VARCHAR AS name, length(seq)::BIGINT AS length, least(length(seq), 80)::INTEGER AS line_bases, (least(length(seq), 80) + 1)::INTEGER AS line_width FROM reads WHERE length(seq) > 0")
def _(spark, sf):
    """The index of FASTA files, itself written and read; offsets, which depend on the cut into files, have tests."""
    df = reads(spark, sf).where("seq <> ''")
    built = fai.build_fai(spark, stored(df, writers.fasta_lines(_text("id"), F.col("seq")), "fasta"))
    return readers.read_fai(spark, stored(built, writers.fai_lines(built), "fai")).drop("offset")


_BED = """SELECT 'chr' || chrom AS chrom, start, "end", 'e' || id AS name, id % 1000 AS score, CASE id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS strand FROM """


def _bed(spark: SparkSession, sf: str) -> DataFrame:
    df = intervals(spark, sf)
    strand = F.when(F.col("id") % 3 == 0, "+").when(F.col("id") % 3 == 1, "-").otherwise(".")
    return df.select(F.concat(F.lit("chr"), _text("chrom")).alias("chrom"), "start", "end", F.concat(F.lit("e"), _text("id")).alias("name"), (F.col("id") % 1000).alias("score"), strand.alias("strand"), "id")


_columns = lambda *names: [F.col(n) for n in names]


@query("bed3_file", f"WITH {INTERVALS}, b AS ({_BED} intervals) SELECT chrom, start, \"end\" FROM b")
def _(spark, sf):
    df = _bed(spark, sf)
    return readers.read_bed(spark, stored(df, writers.bed_lines(*_columns("chrom", "start", "end")), "bed3"))


@query("bed6_file", f"WITH {INTERVALS} {_BED} intervals")
def _(spark, sf):
    df = _bed(spark, sf)
    return readers.read_bed(spark, stored(df, writers.bed_lines(*_columns("chrom", "start", "end", "name", "score", "strand")), "bed6"), 6)


@query("bed12_file", f"""WITH {INTERVALS}, b AS ({_BED} intervals) SELECT *, start AS thick_start, "end" AS thick_end, 2::INTEGER AS block_count, '1,1' AS sizes, '0,' || ("end" - start - 1) AS starts FROM b""")
def _(spark, sf):
    df = _bed(spark, sf)
    blocks = [F.lit("1,1"), F.concat(F.lit("0,"), (F.col("end") - F.col("start") - 1).cast("string"))]
    line = writers.bed_lines(*_columns("chrom", "start", "end", "name", "score", "strand", "start", "end"), F.lit(None).cast("string"), F.lit(2), *blocks)
    found = readers.read_bed(spark, stored(df, line, "bed12"), 12)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "block_count", listed("block_sizes").alias("sizes"), listed("block_starts").alias("starts"))


@query("narrowpeak_file", f"""WITH {INTERVALS}, b AS ({_BED} intervals), p AS (SELECT *, substr(name, 2)::BIGINT AS id FROM b)
  SELECT chrom, start, "end", name, id % 64 / 4.0::DOUBLE AS signal_value, CASE WHEN id % 5 = 0 THEN NULL ELSE id % 16 / 4.0::DOUBLE END AS p_value, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 8 / 4.0::DOUBLE END AS q_value,
  start + ("end" - start) // 2 AS peak_position, id % 5 <> 0 AND id % 7 <> 0 AND id % 16 >= 8 AND id % 8 >= 4 AS significant FROM p""")
def _(spark, sf):
    df = _bed(spark, sf)
    share = lambda m: (F.col("id") % m / F.lit(4.0)).cast("double")
    peak = F.expr("(`end` - start) DIV 2")
    line = writers.bed_lines(*_columns("chrom", "start", "end", "name", "score", "strand"), share(64), F.when(F.col("id") % 5 == 0, -1.0).otherwise(share(16)), F.when(F.col("id") % 7 == 0, -1.0).otherwise(share(8)), peak)
    found = readers.read_narrowpeak(spark, stored(df, line, "narrowpeak"))
    return found.select("chrom", "start", "end", "name", "signal_value", "p_value", "q_value", "peak_position", R.is_significant(F.col("p_value"), F.col("q_value"), 2.0, 1.0).alias("significant"))


_FEATURES = "SELECT 'chr' || (p_partkey % 4) AS seqid, CASE WHEN p_size % 2 = 0 THEN 'gene' ELSE 'exon' END AS feature, p_partkey * 50 + 1 AS start, p_partkey * 50 + p_size AS \"end\", CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size / 4.0 AS DOUBLE) END AS score, CASE WHEN p_size % 3 = 0 THEN '-' ELSE '+' END AS strand, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size % 3 END AS phase, p_partkey, p_type FROM "


def _features(spark: SparkSession, sf: str, attributes: dict[str, Column]) -> DataFrame:
    view = _FEATURES.replace('"end"', "`end`") + "{t}"
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in attributes]), F.array(*attributes.values()))
    df = _made(table(spark, sf, "part"), view).withColumn("source", F.lit("helix"))
    return df.withColumn("attributes", F.map_filter(entries, lambda k, v: v.isNotNull()))


def _described(df: DataFrame, **values: Column) -> DataFrame:
    span = {"from_zero": R.interval_start(F.col("start")), "length": R.feature_length(F.col("start"), F.col("end"))}
    return df.select("seqid", "feature", "start", "end", "score", "strand", "phase", *[c.alias(n) for n, c in (span | values).items()])


_DESCRIBED = 'seqid, feature, start, "end", score, strand, phase::INTEGER AS phase, start - 1 AS from_zero, "end" - start + 1 AS length'


@query("gff3_file", f"WITH f AS ({_FEATURES} part) SELECT {_DESCRIBED}, 'part' || p_partkey AS id, p_type AS name, CASE WHEN feature = 'exon' THEN 'g' || (p_partkey // 10) END AS parent FROM f")
def _(spark, sf):
    part = F.col("p_partkey")
    parent = F.when(F.col("feature") == "exon", F.concat(F.lit("g"), F.expr("p_partkey DIV 10").cast("string")))
    df = _features(spark, sf, {"ID": F.concat(F.lit("part"), part.cast("string")), "Name": F.col("p_type"), "Parent": parent})
    found = readers.read_gff3(spark, stored(df, writers.feature_lines(df), "gff3", writers.GFF3_HEADER))
    of = lambda k: R.attribute(F.col("attributes"), k)
    return _described(found, id=of("ID"), name=of("Name"), parent=of("Parent"))


@query("gtf_file", f"WITH f AS ({_FEATURES} part) SELECT {_DESCRIBED}, 'g' || (p_partkey // 10) AS gene_id, CASE WHEN feature = 'exon' THEN 't' || p_partkey END AS transcript_id, p_type AS biotype FROM f")
def _(spark, sf):
    transcript = F.when(F.col("feature") == "exon", F.concat(F.lit("t"), _text("p_partkey")))
    df = _features(spark, sf, {"gene_id": F.concat(F.lit("g"), F.expr("p_partkey DIV 10").cast("string")), "transcript_id": transcript, "gene_biotype": F.col("p_type")})
    found = readers.read_gtf(spark, stored(df, writers.feature_lines(df, gtf=True), "gtf"))
    of = lambda k: R.attribute(F.col("attributes"), k)
    return _described(found, gene_id=of("gene_id"), transcript_id=of("transcript_id"), biotype=R.gene_biotype(F.col("attributes")))


_CALLS = """SELECT 'chr' || (p_partkey % 4) AS chrom, p_partkey + 1 AS pos, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'rs' || p_partkey END AS id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'ACG' END AS ref,
  CASE WHEN p_size % 6 = 0 THEN '' WHEN p_size % 5 = 0 THEN 'T,GG' ELSE 'C' END AS alts, CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size / 2.0 AS DOUBLE) END AS qual, CASE WHEN p_size % 7 = 0 THEN 'q10;s50' WHEN p_size % 11 = 0 THEN NULL ELSE 'PASS' END AS filter, p_size AS dp, p_size % 3 = 0 AS db FROM """


@query("vcf_file", f"WITH v AS ({_CALLS} part) SELECT *, pos - 1 + length(ref) AS \"end\", coalesce(filter = 'PASS', false) AS pass, CASE WHEN db THEN '1/1' ELSE '0|1' END AS genotype, NULLIF(dp % 13, 0)::BIGINT AS depth, 's1,s2' AS samples FROM v")
def _(spark, sf):
    df = _made(table(spark, sf, "part"), _CALLS + "{t}")
    alt = F.filter(F.split("alts", ","), lambda a: a != "")
    info = F.map_filter(F.map_from_arrays(F.array(F.lit("DP"), F.lit("DB")), F.array(_text("dp"), F.when(F.col("db"), ""))), lambda k, v: v.isNotNull())
    depth = F.coalesce(F.nullif(F.col("dp") % 13, F.lit(0)).cast("string"), F.lit("."))
    one = F.concat(F.when(F.col("db"), "1/1").otherwise("0|1"), F.lit(":"), depth)
    df = df.withColumns({"alt": alt, "info": info, "format": F.lit("GT:DP"), "samples": F.array(one, F.lit("./.:."))})
    names = ["s1", "s2"]
    header = writers.vcf_header_lines(names, {"DP": "Depth", "DB": "Known"}, {"GT": "Genotype", "DP": "Depth"}, {"q10": "Low"}, {"chr0": 10**9, "chr1": None})
    path = stored(df, writers.vcf_lines(df), "vcf", header)
    got, info, first = readers.read_vcf(spark, path), F.col("info"), F.col("samples")[0]
    return got.select(
        "chrom", "pos", "id", "ref", F.array_join("alt", ",").alias("alts"), "qual", "filter", info["DP"].cast("int").alias("dp"), info["DB"].isNotNull().alias("db"), R.variant_end(F.col("pos"), F.col("ref")).alias("end"), R.passes(F.col("filter")).alias("pass"),
        R.sample_value(F.col("format"), first, "GT").alias("genotype"), R.sample_value(F.col("format"), first, "DP").cast("bigint").alias("depth"), F.lit(",".join(readers.vcf_samples(spark, path))).alias("samples"),
    )


def _graph_files(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    tags = lambda names, *values: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    segments = part.select(F.concat(F.lit("s"), _text("p_partkey")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("A"), F.col("p_size"))).alias("sequence"), tags(["LN", "KC"], F.concat(F.lit("i:"), _text("p_size")), F.concat(F.lit("i:"), (F.col("p_size") * 3).cast("string"))).alias("tags"))
    sign = lambda c, m: F.when(F.col(c) % m == 0, "+").otherwise("-")
    links = line.select(F.concat(F.lit("s"), _text("l_partkey")).alias("from_segment"), sign("l_linenumber", 2).alias("from_orient"), F.concat(F.lit("s"), (F.col("l_partkey") + F.col("l_suppkey")).cast("string")).alias("to_segment"), sign("l_suppkey", 3).alias("to_orient"), F.concat(_text("l_linenumber"), F.lit("M")).alias("overlap"), tags(["NM"], F.concat(F.lit("i:"), _text("l_linenumber"))).alias("tags"))
    step = F.struct("l_linenumber", F.concat(F.lit("s"), _text("l_partkey"), sign("l_linenumber", 2)).alias("s"))
    paths = line.groupBy(F.concat(F.lit("o"), _text("l_orderkey")).alias("name")).agg(F.array_sort(F.collect_list(step)).alias("steps")).select("name", F.col("steps.s").alias("steps"), F.array(F.lit("*")).alias("overlaps"))
    return readers.read_gfa(spark, stored(writers.gfa_lines(segments, links, paths), "line", "gfa"))


@query("gfa_segments_file", "SELECT 's' || p_partkey AS name, p_size::BIGINT AS length, p_size * 3.0::DOUBLE AS coverage FROM part")
def _(spark, sf):
    return _graph_files(spark, sf)["segments"].select("name", "length", R.segment_coverage(F.col("tags")).alias("coverage"))


@query("gfa_headers_file", "SELECT '1.0' AS version")
def _(spark, sf):
    return _graph_files(spark, sf)["headers"].select(R.tag(F.col("tags"), "VN").alias("version"))


@query("gfa_links_file", "SELECT 's' || l_partkey AS from_segment, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS from_orient, 's' || (l_partkey + l_suppkey) AS to_segment, CASE WHEN l_suppkey % 3 = 0 THEN '+' ELSE '-' END AS to_orient, l_linenumber || 'M' AS overlap, l_linenumber::BIGINT AS nm FROM lineitem")
def _(spark, sf):
    return _graph_files(spark, sf)["links"].select("from_segment", "from_orient", "to_segment", "to_orient", "overlap", R.tag(F.col("tags"), "NM", "bigint").alias("nm"))


@query("gfa_paths_file", "SELECT 'o' || l_orderkey AS name, string_agg('s' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END, ',' ORDER BY l_linenumber, 's' || l_partkey) AS steps, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def _(spark, sf):
    """The order of a path's steps is part of the record; a path has as many as its order has lines."""
    return _graph_files(spark, sf)["paths"].select("name", F.array_join("steps", ",").alias("steps"), F.size("steps").cast("bigint").alias("n"))


_MATCHES = """SELECT 'q' || l_orderkey AS query_name, 1000::BIGINT AS query_length, l_linenumber::BIGINT AS query_start, (l_linenumber + l_quantity)::BIGINT AS query_end, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, 't' || l_suppkey AS target_name, l_partkey * 100 AS target_length,
  l_linenumber::BIGINT AS target_start, (l_linenumber + l_quantity)::BIGINT AS target_end, (l_quantity - 1)::BIGINT AS num_matches, l_quantity::BIGINT AS alignment_length, (CASE WHEN l_linenumber = 7 THEN 255 ELSE l_quantity END)::INTEGER AS mapq FROM """


@query("paf_file", f"WITH m AS ({_MATCHES} lineitem) SELECT *, num_matches / alignment_length::DOUBLE AS identity, (query_end - query_start) / query_length::DOUBLE AS query_coverage, CASE WHEN target_length = 0 THEN 0.0 ELSE (target_end - target_start) / target_length::DOUBLE END AS target_coverage, mapq >= 30 AND mapq < 255 AS good, strand = '+' AS forward, query_end - query_start AS query_bases, target_end - target_start AS target_bases FROM m")
def _(spark, sf):
    df = _made(table(spark, sf, "lineitem"), _MATCHES + "{t}")
    c = F.col
    return readers.read_paf(spark, stored(df, writers.paf_lines(df), "paf")).select(
        "*", A.fraction(c("num_matches"), c("alignment_length")).alias("identity"), R.aligned_share(c("query_start"), c("query_end"), c("query_length")).alias("query_coverage"),
        R.aligned_share(c("target_start"), c("target_end"), c("target_length")).alias("target_coverage"), A.is_high_quality(c("mapq"), 30).alias("good"), (c("strand") == "+").alias("forward"),
        R.aligned_length(c("query_start"), c("query_end")).alias("query_bases"), R.aligned_length(c("target_start"), c("target_end")).alias("target_bases"),
    )


_HITS = """SELECT 'q' || l_orderkey AS qseqid, 's' || l_partkey AS sseqid, CAST(90 + l_linenumber + 0.25 AS DOUBLE) AS pident, l_quantity::INTEGER AS length, l_linenumber AS mismatch, 0 AS gapopen, l_linenumber AS qstart, (l_linenumber + l_quantity)::INTEGER AS qend,
  (CASE WHEN l_linestatus = 'F' THEN 100 ELSE 200 END)::INTEGER AS sstart, (CASE WHEN l_linestatus = 'F' THEN 100 + l_quantity ELSE 200 - l_quantity END)::INTEGER AS send, l_discount AS evalue, l_extendedprice AS bitscore FROM """


@query("blast_file", f"WITH h AS ({_HITS} lineitem) SELECT *, pident / 100 AS identity, qend - qstart + 1 AS query_bases, CASE WHEN send > sstart THEN send - sstart + 1 ELSE 1 END AS subject_bases, pident >= 93 AND evalue <= 0.05 AS good FROM h")
def _(spark, sf):
    df = _made(table(spark, sf, "lineitem"), _HITS + "{t}")
    c = F.col
    return readers.read_blast(spark, stored(df, writers.blast_lines(df), "blast")).select(
        "*", (c("pident") / 100).alias("identity"), A.blast_coverage(c("qstart"), c("qend")).alias("query_bases"), A.blast_coverage(c("sstart"), c("send")).alias("subject_bases"), R.is_good_match(c("pident"), c("evalue"), 93, 0.05).alias("good")
    )


_RECORDS = "SELECT 'r' || l_orderkey || '.' || l_linenumber AS name, flags, 'chr' || reference_id AS reference, CAST(position AS INTEGER) AS position, mapq, cigar, 'chr' || mate_reference_id AS mate_reference, CAST(CASE WHEN mate_reference_id IS NULL THEN NULL ELSE position + 100 END AS INTEGER) AS mate_position, CAST(template_length AS INTEGER) AS template_length, nm FROM "
_SHOWN = ["name", "flags", "reference", "position", "mapq", "cigar", "mate_reference", "mate_position", "template_length"]
REFERENCES = [(f"chr{i}", 2_000_000_000) for i in range(4)]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    number = F.concat(F.lit("i:"), F.col("nm").cast("string"))
    # Cases instead of a filter of the map, so that generated code makes it.
    edits, group = (F.lit("NM"), number), (F.lit("RG"), F.concat(F.lit("Z:g"), _text("mapq")))
    both = F.when(F.col("mapq").isNull(), F.create_map(*edits)).otherwise(F.create_map(*edits, *group))
    tags = F.when(F.col("nm").isNotNull(), both).when(F.col("mapq").isNotNull(), F.create_map(*group)).otherwise(F.create_map().cast("map<string,string>"))
    df = _made(alignments(spark, sf), _RECORDS + "{t}")
    return df.select(*_SHOWN, F.lit("ACGTN").alias("sequence"), F.when(F.col("nm") > 5, "!5?I~").alias("quality"), tags.alias("tags"))


def _of_records(df: DataFrame) -> DataFrame:
    tags = F.col("tags")
    return df.select(*_SHOWN, "sequence", "quality", R.alignment_tag(tags, "edit_distance").alias("nm"), R.alignment_tag(tags, "read_group").alias("rg"))


_RECORDS_SQL = f"WITH {ALIGNMENTS} SELECT r.* EXCLUDE (nm), 'ACGTN' AS sequence, CASE WHEN nm > 5 THEN '!5?I~' END AS quality, nm::BIGINT AS nm, 'g' || mapq AS rg FROM ({_RECORDS} alignments) r"


@query("sam_file", _RECORDS_SQL)
def _(spark, sf):
    df = _records(spark, sf)
    return _of_records(readers.read_sam(spark, stored(df, writers.sam_lines(df), "sam", writers.sam_header_lines(REFERENCES))))


@query("bam_records", _RECORDS_SQL)
def _(spark, sf):
    """Records as compressed blocks, made and read where the rows are."""
    return _of_records(bam.block_records(bam.bam_blocks(_records(spark, sf), REFERENCES), REFERENCES))


def _bam_files(spark: SparkSession, sf: str) -> str:
    path = scratch.new_path(spark, "bam")
    bam.write_bam_files(_records(spark, sf), REFERENCES, path)
    return path


@query("bam_file", _RECORDS_SQL)
def _(spark, sf):
    return _of_records(bam.read_bam(spark, _bam_files(spark, sf)))


@query("bam_references_file", "SELECT 'chr' || i AS name, 2000000000::BIGINT AS length FROM range(4) t(i)")
def _(spark, sf):
    """The references of all files, which have the same."""
    return bam.bam_references(spark, _bam_files(spark, sf)).distinct()


_REGION = ("chr1", 20_000, 60_000)


_IN_REGION = f"reference = '{_REGION[0]}' AND position < {_REGION[2]} AND position + list_sum([x::BIGINT FOR x IN regexp_extract_all(cigar, '(\\d+)[MDN=X]', 1)]) > {_REGION[1]}"


@query("bam_region", f"SELECT * FROM ({_RECORDS_SQL}) WHERE {_IN_REGION}")
def _(spark, sf):
    return _of_records(bam.read_bam(spark, _bam_files(spark, sf), _REGION))


def _columns_of_bam(spark: SparkSession, sf: str) -> str:
    path = scratch.new_path(spark, "columns")
    columnar.write_columns(bam.read_bam(spark, _bam_files(spark, sf)), path)
    return path


@query("columnar_sam", _RECORDS_SQL)
def _(spark, sf):
    """BAM files as columns, and these as SAM lines."""
    df = columnar.read_columns(spark, _columns_of_bam(spark, sf))
    return _of_records(readers.read_sam(spark, stored(df, writers.sam_lines(df), "sam", writers.sam_header_lines(REFERENCES))))


@query("columnar_region", f"SELECT * FROM ({_RECORDS_SQL}) WHERE {_IN_REGION}")
def _(spark, sf):
    return _of_records(columnar.read_columns(spark, _columns_of_bam(spark, sf), _REGION))


@query("genbank_file", "SELECT 'L' || p_partkey AS locus, p_size::BIGINT AS length, 'Part ' || p_partkey || ' of ' || p_brand || '.' AS definition, 'AC' || p_partkey AS accession, p_type AS organism, 'gene' AS key, '1..' || p_size AS location, 'g' || p_partkey AS gene, repeat('acgt', p_size) AS sequence FROM part")
def _(spark, sf):
    number = _text("p_partkey")
    text = F.concat(
        F.lit("LOCUS       L"), number, F.lit(" "), _text("p_size"), F.lit(" bp    DNA     linear   PLN 21-JUN-1999\nDEFINITION  Part "), number, F.lit("\n            of "), F.col("p_brand"), F.lit(".\nACCESSION   AC"), number,
        F.lit("\nSOURCE      s\n  ORGANISM  "), F.col("p_type"), F.lit("\n            Eukaryota; Fungi.\nFEATURES             Location/Qualifiers\n     gene            1.."), _text("p_size"), F.lit('\n                     /gene="g'), number,
        F.lit('"\nORIGIN\n        1 '), F.rtrim(F.repeat(F.lit("acgt "), F.col("p_size"))), F.lit("\n//"),
    )
    found = genbank.read_genbank(spark, stored(table(spark, sf, "part"), text, "genbank"))
    one = F.col("features")[0]
    return found.select("locus", "length", "definition", "accession", "organism", one["key"].alias("key"), one["location"].alias("location"), one["qualifiers"][0]["v"].alias("gene"), "sequence")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The table of events as a stream of its files; as a pattern, since a stream's path can't be one file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/event[s].parquet")


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    """Keys seen in a stream, each once: the events come in one batch here, so none is late."""
    seen = counters.first_seen(_stream(spark, sf), ["user_id", "event_type"], "400 days").select("user_id", "event_type")
    return counters.drained(seen, scratch.new_path(spark, "seen"))


@query("stream_totals", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, max(value) AS greatest FROM events GROUP BY 1")
def _(spark, sf):
    """Running totals by user, the last of each being its greatest count."""
    rows = counters.drained(counters.running_totals(_stream(spark, sf), "user_id", "value", "400 days"), scratch.new_path(spark, "totals"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("n", "total", "greatest"), "n").alias("v"))
    return last.select(F.col("key").alias("user_id"), "v.n", F.round("v.total", 6).alias("total"), "v.greatest")
