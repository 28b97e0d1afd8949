"""The engine's queries against DuckDB at the smallest size, and readers, writers and edge cases on literals."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from helixframe.functions import alignment as A
from helixframe.functions import records as R
from helixframe.functions import sequence as S
from helixframe.operators import derive, intervals, kmers, local_alignment
from helixframe.plans import catalog
from helixframe.sources import readers, writers
from helixframe.streaming import counters

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_sites_depth_of_every_cigar(spark):
    rows = derive.alignments(spark, SF).select("reference_id", "position", "cigar").collect()
    assert {r.cigar for r in rows} == set(derive.CIGARS)
    sites = {(r.p_partkey % 4, r.p_partkey * 50 + 30) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {}
    for r in rows:
        at = r.position
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", r.cigar):
            for p in range(at, at + int(n)) if op in "M=X" else ():
                if (r.reference_id, p) in sites:
                    want[r.reference_id, p] = want.get((r.reference_id, p), 0) + 1
            at += int(n) if op in "MDN=X" else 0
    got = {(r.reference_id, r.position): r.depth for r in catalog.queries()["sites_depth"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def brute_nthash(seq, k, w):
    """Rolling hashes, N as 0; the leftmost least of each full window, repeats in a row once."""
    mask, seeds = (1 << 64) - 1, {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456, "N": 0}
    rotl = lambda x, n: (x << n % 64 | x >> (64 - n % 64)) & mask
    ahead, back = [seeds[c] for c in seq], [seeds[c.translate(str.maketrans("ACGT", "TGCA"))] for c in seq]
    f = r = 0
    hashes = []
    for i in range(len(seq)):
        f, r = rotl(f, 1) ^ ahead[i], rotl(r, 63) ^ rotl(back[i], k - 1)
        if i >= k:
            f, r = f ^ rotl(ahead[i - k], k), r ^ rotl(back[i - k], 63)
        if i >= k - 1:
            hashes.append(min(f, r))
    found = []
    for i in range(len(hashes) - w + 1):
        h, at = min((hashes[j], j) for j in range(i, i + w))
        if not found or found[-1][0] != at:
            found.append((at, h - (h >> 63 << 64)))
    return found


def test_nthash_minimizers_take_every_read(spark):
    held = {1: "ACGTNACGTACGGTNNTACA", 2: "N" * 12, 3: "ACGTACG", 4: "ACGTACGA", 5: "NACGTACG", 6: "", 7: "TTTTTTTTTN"}
    small = kmers.nthash_minimizers(spark.createDataFrame(list(held.items()), "id long, seq string"), 5, 4)
    assert sorted(map(tuple, small.collect())) == sorted((i, *m) for i, s in held.items() for m in brute_nthash(s, 5, 4))
    reads = derive.reads(spark, SF).select("id", "seq").collect()
    assert any("N" in r.seq and len(r.seq) > 1000 for r in reads)
    got = catalog.queries()["minimizers_nthash"](spark, SF).select("id", "position", "hash")
    assert sorted(map(tuple, got.collect())) == sorted((r.id, *m) for r in reads for m in brute_nthash(r.seq, 5, 4))


def test_smith_waterman_small(spark):
    assert local_alignment.align("ACGT", "ACGT") == (8, 0, 4, 0, 4, "4M")
    assert local_alignment.align("", "ACGT") == (0, 0, 0, 0, 0, "")
    assert local_alignment.align("AAACCCGGG", "AAAGGG", 2, -1, -1)[0] == 9


def test_window_trim_edges(spark):
    rows = spark.createDataFrame([("",), ("!!!",), ("III",), ("IIIII!!!!!",), ("!!!!!!!!",)], "q string")
    assert [r[0] for r in rows.select(S.window_cut(F.col("q"), 20, 5)).collect()] == [0, 0, 3, 7, 8]


def test_cigar(spark):
    ops = A.parse_cigar(F.lit("3M2M1D4S"))
    r = spark.range(1).select(A.format_cigar(A.compress_cigar(ops)), A.cigar_length(ops), A.cigar_length(ops, A.QUERY_OPS)).first()
    assert tuple(r) == ("5M1D4S", 6, 9)


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert readers.read_bed(spark, put("a.bed", "# x\nchr1\t1\t5\tn\t7\t+\n\nchr2\t2\t9\t.\t.\t.\n"), 6).count() == 2
    gff = readers.read_gff3(spark, put("a.gff", "chr1\ts\tgene\t1\t9\t.\t+\t.\tID=g1;Name=x=y;ID=g2\n")).first()
    assert gff.attributes == {"ID": "g2", "Name": "x=y"} and gff.score is None
    gtf = readers.read_gtf(spark, put("a.gtf", 'chr1\ts\texon\t1\t9\t.\t+\t0\tgene_id "g"; transcript_id "t";\n'))
    assert gtf.first().attributes == {"gene_id": "g", "transcript_id": "t"}
    assert gtf.select(writers.feature_lines(gtf, gtf=True)).first()[0].endswith('gene_id "g"; transcript_id "t";')
    vcf = readers.read_vcf(spark, put("a.vcf", "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\nchr1\t7\t.\tG\tC,T\t30\tPASS\tDP=3;DB\tGT\t0/1\n"))
    assert vcf.first().info == {"DP": "3", "DB": ""} and vcf.first().alt == ["C", "T"] and readers.vcf_samples(spark, str(tmp_path / "a.vcf")) == ["S1"]
    assert vcf.select(writers.vcf_lines(vcf)).first()[0] == "chr1\t7\t.\tG\tC,T\t30\tPASS\tDB;DP=3\tGT\t0/1"
    gfa = readers.read_gfa(spark, put("a.gfa", "H\tVN:Z:1.0\nS\ts1\tACGT\tKC:i:5\nS\ts2\t*\tLN:i:9\nL\ts1\t+\ts2\t-\t0M\nP\tp\ts1+,s2-\t*\n"))
    assert {r.name: r.length for r in gfa["segments"].collect()} == {"s1": 4, "s2": 9} and gfa["links"].count() == 1 and gfa["paths"].first().steps == ["s1+", "s2-"]
    assert {(r.id, r.sequence) for r in readers.read_fasta(spark, put("a.fa", ">a desc\nAC\nGT\n>b\nTT\n")).collect()} == {("a", "ACGT"), ("b", "TT")}
    fq = readers.numbered_fastq(spark, put("a.fq", "@r1 x\nACG\n+\n@II\n@r2\nA\n+\nI\n"))
    assert [(r.nth, r.id, r.quality) for r in fq.orderBy("nth").collect()] == [(0, "r1 x", "@II"), (1, "r2", "I")]
    assert readers.pair_fastq(fq, fq).count() == 2
    sam = readers.read_sam(spark, put("a.sam", "@SQ\tSN:chr1\tLN:100\nr\t99\tchr1\t8\t255\t4M\t=\t20\t5\tACGT\tIIII\tNM:i:2\n")).first()
    assert (sam.position, sam.mapq, sam.mate_reference, sam.tags) == (7, None, "chr1", {"NM": "i:2"})
    assert readers.read_paf(spark, put("a.paf", "q\t10\t0\t9\t+\tt\t20\t1\t10\t9\t9\t60\n")).first().mapq == 60
    with pytest.raises(Exception):
        readers.read_bed(spark, put("b.bed", "chr1\t9\t5\n")).collect()


@pytest.mark.parametrize("text", ["@a\nACG\n+\n@@I\n@b x\nA\n+\n@\n@c\n\n+\n\n@@d\nAC\n+d\n+@\n@e\nACGT\n+\n@III\n@f\nA\n+\n@\n", "@a\r\nAC\r\n+\r\n@I\r\n@b\r\nA\r\n+\r\n@", "@a\nA\n+\nI", "\n", ""])
def test_fastq_cut_anywhere(spark, tmp_path, text):
    path = tmp_path / "a.fq"
    path.write_bytes(text.encode())
    lines = text.replace("\r", "").split("\n") if text.strip() else []
    want = [(i // 4, lines[i][1:], lines[i + 1], lines[i + 3]) for i in range(0, len(lines) - 3, 4)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (4, 7, 19, 1000):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            assert sorted(map(tuple, readers.numbered_fastq(spark, str(path)).collect())) == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ["a\nA\n+\nI\n", "@a\nA\n+\n", "@a\nA\nI\n", "@a\nAC\n+\nI\n", "@a\nA\n+\nI\nx\n@b\nA\n+\nI\n"])
def test_fastq_errors(spark, tmp_path, text):
    (tmp_path / "a.fq").write_text(text)
    with pytest.raises(Exception):
        readers.read_fastq(spark, str(tmp_path / "a.fq")).collect()


def test_mates_over_files(spark, tmp_path):
    record = lambda i, m: f"@r{i}/{m}\nACG\n+\n{'@' if i % 3 == 0 else 'I'}II\n"
    for m, cut in ((1, 40), (2, 70)):
        (tmp_path / str(m)).mkdir()
        for name, span in (("a.fq", range(cut)), ("b.fq", range(cut, 100))):
            (tmp_path / str(m) / name).write_text("".join(record(i, m) for i in span))
    both = readers.pair_fastq(*(readers.numbered_fastq(spark, str(tmp_path / m)) for m in "12")).orderBy("nth").collect()
    assert [(r.nth, r.id1, r.id2) for r in both] == [(i, f"r{i}/1", f"r{i}/2") for i in range(100)]


def test_record_values(spark):
    tags = "map('NM', 'i:3', 'RG', 'Z:g:1', 'XB', 'B:s,1,-2', 'KC', 'i:7')"
    of = lambda c: spark.sql(f"SELECT {tags} AS t").select(c).first()[0]
    t = F.col("t")
    assert of(R.alignment_tag(t, "edit_distance")) == 3 and of(R.alignment_tag(t, "read_group")) == "g:1" and of(R.alignment_tag(t, "alignment_score")) is None
    assert of(R.tag(t, "RG", "bigint")) is None and of(R.tag_numbers(t, "XB")) == [1.0, -2.0] and of(R.tag_numbers(t, "NM")) is None and of(R.segment_coverage(t)) == 7.0
    value = lambda s, k: of(R.sample_value(F.lit("GT:DP:GQ"), F.lit(s), k))
    assert [value("0/1:.:9", "GT"), value("0/1:.:9", "DP"), value("0/1", "GQ"), value("0/1:2:9", "XX")] == ["0/1", None, None, None]


def test_written_rules(spark):
    row = lambda feature, start, attributes: spark.sql(f"SELECT 'c' AS seqid, 's' AS source, '{feature}' AS feature, {start}L AS start, 9L AS end, 1.5D AS score, '+' AS strand, CAST(NULL AS INT) AS phase, {attributes} AS attributes")
    line = lambda df: df.select(writers.feature_lines(df, gtf=True)).first()[0]
    assert line(row("gene", 1, "map('gene_id', 'g')")) == 'c\ts\tgene\t1\t9\t1.50\t+\t.\tgene_id "g";'
    for bad in (row("exon", 1, "map('gene_id', 'g')"), row("gene", 1, "map('transcript_id', 't')"), row("gene", 0, "map('gene_id', 'g')")):
        with pytest.raises(Exception, match="bad feature row"):
            line(bad)
    assert writers.vcf_header_lines(["s"], {"DP": "Depth"}, contigs={"c": 5, "d": None}, other=["x=y"]) == ["##fileformat=VCFv4.2", '##INFO=<ID=DP,Description="Depth">', "##contig=<ID=c,length=5>", "##contig=<ID=d>", "##x=y", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"]
    assert writers.sam_header_lines([("c", 5)]) == ["@HD\tVN:1.6\tSO:unknown", "@SQ\tSN:c\tLN:5"]


def test_stream_state_over_batches(spark, tmp_path):
    rows = [[(0, 1, 2.0), (10, 1, 5.0), (20, 2, 1.0)], [(30, 1, 1.0), (40, 3, 4.0)], [(9000, 4, 1.0)], [(50, 5, 1.0), (9001, 4, 3.0), (9002, 1, 7.0)], [(9003, 4, 0.5)]]
    for i, part in enumerate(rows):
        made = spark.createDataFrame(part, "s long, user_id long, value double").select(F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"), "user_id", "value")
        made.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    schema = made.schema

    def run(build, name):
        """One batch for each folder, in order: a file of each is added after the one before has been read."""
        (tmp_path / name).mkdir()
        for i in range(len(rows)):
            source = next((tmp_path / f"b{i}").glob("*.parquet"))
            (tmp_path / name / f"{i}.parquet").write_bytes(source.read_bytes())
            out = counters.drained(build(spark.readStream.schema(schema).parquet(str(tmp_path / name))), str(tmp_path / f"{name}-out"))
        return out

    totals = run(lambda s: counters.running_totals(s, "user_id", "value", "60 seconds"), "totals")
    got = sorted(map(tuple, totals.collect()))
    # User 1 was idle past the watermark before its last event, so its state began anew; the late event of user 5 is dropped.
    assert got == [(1, 1, 7.0, 7.0), (1, 2, 7.0, 5.0), (1, 3, 8.0, 5.0), (2, 1, 1.0, 1.0), (3, 1, 4.0, 4.0), (4, 1, 1.0, 1.0), (4, 2, 4.0, 3.0), (4, 3, 4.5, 3.0)]
    seen = run(lambda s: counters.first_seen(s, ["user_id"], "60 seconds").select("user_id"), "seen")
    # Likewise user 1 is new again.
    assert sorted(r.user_id for r in seen.collect()) == [1, 1, 2, 3, 4]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = counters.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert plain(spark.table("windowed").collect()) == plain(counters.windowed_counts(events).collect())


def test_subtract_keeps_intervals_of_one_id_apart(spark):
    left = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 20, 30), (1, 0, 20, 30), (2, 1, 0, 5)], "id long, chrom long, start long, end long")
    right = spark.createDataFrame([(9, 0, 2, 4), (9, 0, 6, 7), (9, 0, 3, 4), (9, 1, 0, 9)], "id long, chrom long, start long, end long")
    got = sorted(map(tuple, intervals.subtract(left, right).collect()))
    assert got == [(1, 0, 0, 2), (1, 0, 4, 6), (1, 0, 7, 10), (1, 0, 20, 30)]


def test_smith_waterman_equals_a_plain_matrix():
    rng = random.Random(3)
    for _ in range(200):
        q, r = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14))) for _ in range(2))
        h = [[0] * (len(r) + 1) for _ in range(len(q) + 1)]
        for i in range(1, len(q) + 1):
            for j in range(1, len(r) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if q[i - 1] == r[j - 1] else -1), h[i - 1][j] - 2, h[i][j - 1] - 2)
        score, qs, qe, rs, re_, cigar = local_alignment.align(q, r)
        assert score == max(map(max, h))
        # The path that the CIGAR tells has that score.
        i, j, total = qs, rs, 0
        for n, op in re.findall(r"(\d+)([MID])", cigar):
            for _ in range(int(n)):
                total += (2 if q[i] == r[j] else -1) if op == "M" else -2
                i, j = i + (op != "D"), j + (op != "I")
        assert (total, i, j) == (score, qe, re_)


def test_readers_check_what_they_read(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert {(r.id, r.sequence) for r in readers.read_fasta(spark, put("n.fa", ">a note x>y\nAC\nGT\n>b >c\r\nTT\r\n")).collect()} == {("a", "ACGT"), ("b", "TT")}
    for line in ("q\t10\t0\t9\t.\tt\t20\t1\t10\t9\t9\t60\n", "# note\n"):
        with pytest.raises(Exception, match="strand|too few"):
            readers.read_paf(spark, put("bad.paf", line)).collect()


def test_quality_of_slices_and_nulls(spark):
    rows = [(i, q) for i, q in enumerate(["IIII", "", None, "!5", "~", "I" * 100000])]
    got = {r.i: r.m for r in spark.createDataFrame(rows, "i int, q string").select("i", S.mean_quality(F.col("q")).alias("m")).collect()}
    assert got == {0: 40.0, 1: 0.0, 2: None, 3: 10.0, 4: 93.0, 5: 40.0}


def test_overlap_join_with_very_long_intervals(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 1), s, s + rng.choice([0, 1, 3, 40, 5_000_000])) for i in range(120) for s in [rng.randint(0, 900)]]
    df = spark.createDataFrame(rows, "id long, chrom long, start long, end long")
    got = sorted((r.l_id, r.r_id) for r in intervals.overlap_join(df, df).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert intervals.overlap_join(df.limit(0), df).count() == 0


def test_substitutions(spark):
    rows = [("ACGT", "ACGT"), ("TCGA", "ACGT"), ("AC", "ACGT"), ("ACGTAA", "ACTT"), ("", "ACGT"), ("ACGT", ""), (None, "A"), ("TTTT", "AAAA")]
    df = spark.createDataFrame(rows, "read string, reference string").withColumn("m", A.mismatches(F.col("read"), F.col("reference")))
    got = df.select("read", "reference", F.transform("m", lambda x: x["position"]).alias("at"), A.apply_substitutions(F.col("reference"), F.col("m")).alias("changed")).collect()
    for r in got:
        if r.read is None:
            assert r["at"] is None and r.changed is None
        else:
            assert r["at"] == [i for i, (a, b) in enumerate(zip(r.read, r.reference)) if a != b]
            assert r.changed == r.read[: len(r.reference)] + r.reference[len(r.read) :]
    beyond = F.expr("array(struct(9 AS position, 'T' AS base), struct(0 AS position, 'G' AS base))")
    assert spark.range(1).select(A.apply_substitutions(F.lit("ACGT"), beyond)).first()[0] == "GCGT"


def test_quality_features(spark):
    of = lambda seq, qual, n: spark.range(1).select(S.quality_features(F.lit(seq), F.lit(qual), n)).first()[0]
    assert of("AcgTN", "!!~~~", 6)[:6] == [0, 0.25, 0.5, 0.75, 1, 0]
    assert of("AcgTN", "!!~~~", 6)[6:] == pytest.approx([33 / 93] * 2 + [126 / 93] * 3 + [0])
    assert of("", "", 2) == [0] * 4 and of("", "", None) == [] and of(None, "I", 3) is None
    for bad in (("AC", "I", 5), ("ACGT", "IIII", 3)):
        with pytest.raises(Exception, match="differ in length"):
            of(*bad)


def test_columns_of_alignments(spark, tmp_path):
    """A region's filters reach the scan; reads without a place or a span are kept, and are in no region."""
    from helixframe.sources import bam, columnar

    rows = [(f"r{i}", 0, "chr1", i * 10, 60, "5M20D5M", None, None, 0, "ACGTACGTAC", None, {"NM": "i:1"}) for i in range(50)]
    rows += [("u", 4, None, None, None, "*", None, None, 0, "A", None, {}), ("s", 0, "chr1", 100, 1, "10S", None, None, 0, "ACGTACGTAC", None, {})]
    columnar.write_columns(spark.createDataFrame(rows, bam.SCHEMA), str(tmp_path / "c"))
    whole, some = columnar.read_columns(spark, str(tmp_path / "c")), columnar.read_columns(spark, str(tmp_path / "c"), ("chr1", 100, 120))
    assert sorted(r.name for r in whole.collect()) == sorted(r[0] for r in rows) and whole.columns == [c.split()[0] for c in bam.SCHEMA.replace("map<string,string>", "map").split(", ")]
    assert sorted(r.name for r in some.collect()) == sorted(f"r{i}" for i in range(50) if i * 10 < 120 and i * 10 + 30 > 100)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "LessThan(position,120)" in plan and "GreaterThan(end_position,100)" in plan and "EqualTo(reference,chr1)" in plan


def brute_minimizers(seq, k, w):
    """Each window's least (hash, position), windows of void k-mers left out, repeats in a row once."""
    found, last = [], max(len(seq) - k + 1 - w, 0)
    for i in range(last + 1) if len(seq) >= k else ():
        valid = []
        for j in range(i, min(i + w, len(seq) - k + 1)):
            if set(text := seq[j : j + k]) <= set("ACGT"):
                h = 0xCBF29CE484222325
                for c in text.encode():
                    h = (h ^ c) * 0x100000001B3 & ((1 << 64) - 1)
                valid.append((h, j, text))
        if valid and (not found or found[-1] != min(valid)):
            found.append(min(valid))
    return found


def test_minimizers_of_odd_reads(spark, monkeypatch):
    rng = random.Random(5)
    held = {1: "", 2: "ACG", 3: "ACGTA", 4: "ACGTAC", 5: "N" * 40, 6: "A" * 30, 7: "ACGTNACGTNACGTACG", 8: "ACGé\U0001f600ACGTTGCAAC\n", 9: None}
    held |= {i: "".join(rng.choices("ACGTN", [5, 5, 5, 5, 1], k=rng.randint(1, 300))) for i in range(10, 60)}
    monkeypatch.setattr(kmers, "_CHARS", 700)
    monkeypatch.setattr(kmers, "_MOST", 40)
    df = spark.createDataFrame(list(held.items()), "id long, seq string").coalesce(1)
    for k, w in ((5, 4), (3, 1), (1, 7)):
        want = [(i, *m) for i, s in held.items() for m in brute_minimizers(s or "", k, w)]
        plan = kmers.minimizers(df, k, w)
        assert sorted((r.id, r.position, r.hi << 32 | r.lo) for r in plan.collect()) == sorted((i, p, h) for i, h, p, _ in want)
        assert "MapInArrow" in plan._jdf.queryExecution().executedPlan().toString()  # arrays of many reads, no lambdas by k-mer
        assert sorted(tuple(r) for r in kmers.minimizer_kmers(df, k, w).collect()) == sorted((i, p, t) for i, _, p, t in want)
    assert kmers.minimizers(df, 0, 4).count() == kmers.minimizers(df, 5, 0).count() == 0


def test_swept_overlaps_of_all_kinds(spark, monkeypatch):
    """Empty, equal, long and nested intervals, over bins, tiles and steps of a few rows; each pair is made once, no other is looked at."""
    rng = random.Random(3)
    for name, value in {"TILE": 7, "STEP": 5, "MOST": 6}.items():
        monkeypatch.setattr(intervals, name, value)
    rows = []
    for i in range(150):
        start = rng.choice([10, 64, rng.randint(0, 300)])
        rows.append((i, rng.choice("xy"), start, start + rng.choice([0, 0, 1, 4, 9, 200])))
    df = spark.createDataFrame([*rows, (150, None, 1, 5), (151, "x", None, 5)], "id long, chrom string, start long, end long")
    hit = [(a, b) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3]]
    inside = [(a, b) for a, b in hit if a[2] <= b[2] and a[3] >= b[3]]
    ids = lambda pairs: sorted((a[0], b[0]) for a, b in pairs)
    got = lambda found: sorted((r.l_id, r.r_id) for r in found.collect())
    assert got(intervals.overlap_join(df, df)) == ids(hit)
    assert got(intervals.overlap_join(df, df, contained=True)) == ids(inside)
    assert got(intervals.self_overlaps(df)) == [p for p in ids(hit) if p[0] < p[1]]
    assert got(intervals.self_overlaps(df, contained=True)) == [p for p in ids(inside) if p[0] != p[1]]


def test_depth_at_repeated_and_bordering_sites(spark):
    """Blocks over the borders of bins, repeated sites, nulls and empty CIGARs; no block is paired with its sites."""
    from helixframe.operators import alignments as stats

    reads = [(0, 16380, "4M2D6M"), (0, 16380, "10="), (0, 5, "*"), (None, 5, "9M"), (1, 16383, "3S40000M"), (1, None, "4M"), (0, 7, None)]
    sites = [(0, p) for p in (16379, 16380, 16383, 16384, 16385, 16386, 16391, 16392)] + [(0, 16384), (1, 16383), (1, 50000), (1, 56383), (2, 1), (None, 3)]
    df = spark.createDataFrame(reads, "reference_id long, position long, cigar string")
    plan = stats.bases_at(df, spark.createDataFrame(sites, "reference_id long, position long"))
    assert sorted(tuple(r) for r in plan.collect()) == [(0, 16380, 2), (0, 16383, 2), (0, 16384, 2), (0, 16385, 1), (0, 16386, 2), (0, 16389 + 2, 1), (1, 16383, 1), (1, 50000, 1)]
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_graph_ends_reduce_links_before_the_join(spark):
    from helixframe.operators import features

    links = spark.createDataFrame([("a", "b")] * 500 + [("b", "c"), (None, "d")], "from_segment string, to_segment string")
    plan = features.ends(spark.createDataFrame([(c,) for c in "abcd"], "name string"), links)
    assert sorted(tuple(r) for r in plan.collect()) == [("a", "source"), ("c", "sink"), ("d", "sink")]
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_differences_are_the_mismatches(spark):
    rows = [("ACGT", "ACGA"), ("A\U0001f600cG", "Aé\U0001f600GTT"), ("", "AC"), ("AC", ""), (None, "A"), ("A", None), ("AAAA", "TTTT")]
    df = spark.createDataFrame(rows, "read string, reference string").withColumn("m", A.mismatches(F.col("read"), F.col("reference"))).withColumn("d", A.differences(F.col("read"), F.col("reference")))
    df = df.withColumn("to", A.substituted(F.col("reference"), F.col("d.positions"), F.col("d.bases"))).withColumn("as", A.apply_substitutions(F.col("reference"), F.col("m")))
    for r in df.collect():
        assert (r.d is None) == (r.m is None)
        assert r.m is None or [(x.position, x.base, x.expected) for x in r.m] == list(zip(*r.d))
        assert r["to"] == (r["as"] if r.m is not None else None)
    beyond = spark.range(1).select(A.substituted(F.lit("ACGT"), F.array(F.lit(9), F.lit(-1), F.lit(0)), F.lit("TTG")))
    assert beyond.first()[0] == "GCGT"


def test_windows_of_qualities_over_many_reads(spark):
    rng = random.Random(9)
    held = {i: "".join(chr(33 + rng.choice([2, 18, 21, 40])) for _ in range(rng.randint(0, 30))) for i in range(400)} | {400: None, 401: "I" * 600_000, 402: "!" * 7 + "I" * 5 + "!" * 700_000}

    def cut(q, least, width):
        v = [ord(c) - 33 for c in q]
        if len(v) < width:
            return len(v) if v and sum(v) // len(v) >= least else 0
        return max((i for i in range(width, len(v) + 1) if sum(v[i - width : i]) // width >= least), default=len(v))

    df = spark.createDataFrame(list(held.items()), "i long, q string").coalesce(1)
    for least, width in ((20, 5), (35, 1), (30, 9)):
        plan = df.select("i", S.window_cut(F.col("q"), least, width).alias("n"))
        assert {r.i: r.n for r in plan.collect()} == {i: None if q is None else cut(q, least, width) for i, q in held.items()}
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()


def test_alignments_of_many_pairs_equal_single_ones():
    rng = random.Random(11)
    text = lambda most, letters="ACGT": "".join(rng.choices(letters, k=rng.randint(0, most)))
    pairs = [(text(24), text(24)) for _ in range(300)] + [(text(5, "A\0"), text(9, "A\0é\U0001f600")) for _ in range(60)] + [(None, "A"), ("A", None), ("", ""), ("ACGT" * 90, "CGTA" * 80)]
    for scores in ((2, -1, -2), (1, 0, -1), (3, -2, 0)):
        assert local_alignment.align_many(*map(list, zip(*pairs)), *scores) == [local_alignment.align(q, r, *scores) for q, r in pairs]


def test_smith_waterman_computes_pairs_together(monkeypatch):
    monkeypatch.setattr(local_alignment, "align", lambda *a: pytest.fail("a small pair was computed alone"))
    assert local_alignment.align_many(["ACGT"] * 9, ["CGTT"] * 9) == [(6, 1, 4, 0, 3, "3M")] * 9


def test_tags_of_lines_are_found_once(spark, tmp_path):
    fixed = "r\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\t"
    (tmp_path / "a.sam").write_text(fixed + "NM:i:1\tXX\tRG:Z:a:b\tNM:i:2 \t\n" + fixed + "AS:i:3\r\n \n" + fixed.rstrip("\t") + "\n")
    plan = readers.read_sam(spark, str(tmp_path / "a.sam"))
    assert sorted(sorted(r.tags.items()) for r in plan.collect()) == [[], [("AS", "i:3")], [("NM", "i:2"), ("RG", "Z:a:b")]]
    said = plan._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("RLIKE") == 1 and "regexp_replace" not in said
