"""Binary and nested formats: round trips, indexes against brute force, and flat files on literals."""

import random
import struct
from itertools import accumulate

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.sources import bam, bcf, fai, genbank, readers, splits, writers
from helixframe.sources.bgzf import BlockReader, deflate_block

REFS = [("chr1", 200_000), ("chr2", 5000)]


@pytest.fixture(scope="module")
def sam(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "a.sam"
    lines = ["@SQ\tSN:chr1\tLN:200000", "@SQ\tSN:chr2\tLN:5000"]
    for i in range(3000):
        lines.append(f"r{i}\t{16 * (i % 2)}\tchr1\t{i * 60 + 1}\t{i % 61}\t3S40M2D7M\t=\t{i * 60 + 200}\t250\t{'ACGTN' * 10}\t{'I' * 50}\tAS:i:{i - 5}\tMD:Z:x{i}\tXB:B:s,1,-2\tXF:f:1.5")
    lines += ["u\t4\t*\t0\t255\t*\t*\t0\t0\tACG\t*", "v\t0\tchr2\t9\t60\t5M\tchr1\t3\t0\tACGTA\tIIIII"]
    path.write_text("\n".join(lines) + "\n")
    return readers.read_sam(spark, str(path))


@pytest.fixture(scope="module")
def bam_file(sam, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bam") / "a.bam")
    bam.write_bam(sam.coalesce(1), REFS, path)
    return path


def index_of(path):
    """A BAI file's content, from the definition: a chunk for each record in its bin, and least offsets of 16 kb windows."""
    source = BlockReader(open(path, "rb").read())
    names = [n for n, _ in bam.read_header(source)[1]]
    bins, floors, at = [{} for _ in names], [{} for _ in names], source.tell()
    for r in bam.records(source, names):
        if r[2] is not None:
            ref, start, end = names.index(r[2]), r[3], r[3] + (49 if r[5] == "3S40M2D7M" else 5)
            bins[ref].setdefault(bam.bin_of(start, end), []).append((at, source.tell()))
            for w in range(start >> 14, ((end - 1) >> 14) + 1):
                floors[ref][w] = min(floors[ref].get(w, at), at)
        at = source.tell()
    out = b"BAI\x01" + struct.pack("<i", len(names))
    for b, f in zip(bins, floors):
        out += struct.pack("<i", len(b))
        for number, chunks in b.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<2Q", *c) for c in chunks)
        line = [f.get(w, 0) for w in range(max(f, default=-1) + 1)]
        out += struct.pack(f"<i{len(line)}Q", len(line), *line)
    return out


def test_blocks():
    data = bytes(range(256)) * 500
    blocks = [deflate_block(data[:60_000]), deflate_block(data[60_000:120_000]), deflate_block(data[120_000:]), deflate_block(b"")]
    assert len(blocks[-1]) == 28
    source = BlockReader(b"".join(blocks))
    assert source.read(59_999) + source.read() == data and source.read(1) == b""
    source.seek(len(blocks[0]) << 16 | 7)
    assert source.tell() == len(blocks[0]) << 16 | 7 and source.read(5) == data[60_007:60_012]
    with pytest.raises(ValueError):
        BlockReader(b"".join(blocks)[:-40]).read()
    with pytest.raises(ValueError):
        BlockReader(b"plain").read()


def test_bam_round_trip(spark, sam, bam_file):
    again = bam.read_bam(spark, bam_file)
    assert again.columns == sam.columns
    plain = lambda df: sorted((str(r.asDict() | {"tags": sorted(r.tags.items())}) for r in df.collect()))
    assert plain(again) == plain(sam)
    assert sorted(map(tuple, bam.bam_references(spark, bam_file).collect())) == REFS


@pytest.fixture(params=[700, 30_000, 90_000])
def border(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _plain(df):
    return sorted(str(r.asDict() | {"tags": sorted(r.tags.items())}) for r in df.collect())


def test_bam_is_split(spark, sam, bam_file, border):
    """Borders of splits anywhere; the writer's blocks end inside records."""
    want = _plain(sam)
    assert splits.raw_blocks(spark, bam_file).rdd.getNumPartitions() > (border < 90_000)
    assert _plain(bam.read_bam(spark, bam_file)) == want


def test_bam_files(spark, sam, tmp_path):
    """A file for each partition, with blocks that end a file between its own; headers that take several scans."""
    path = str(tmp_path / "files")
    bam.write_bam_files(sam.repartition(3), REFS, path)
    bam.write_bam_files(sam.limit(5).coalesce(1), [*REFS, ("other", 9)], path + "2")
    files = [f for f in (tmp_path / "files").iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and all(f.read_bytes().endswith(deflate_block(b"")) for f in files)
    assert _plain(bam.read_bam(spark, path)) == _plain(sam)
    assert sorted(map(tuple, bam.bam_references(spark, path).distinct().collect())) == REFS
    held, splits.HEADERS = splits.HEADERS, 1
    try:
        both = bam.read_bam(spark, str(tmp_path / "files*"))
        assert _plain(both) == _plain(sam.unionAll(sam.limit(5)))
    finally:
        splits.HEADERS = held


def _cut(blocks, borders, rule):
    """Header and records of a file whose splits begin with the blocks of these numbers."""
    at = [0, *borders, len(blocks)]
    walked, whole = [], []
    for begin, end in zip(at, at[1:]):
        split = splits.Split(blocks[begin:end], rule, begin == 0)
        whole += [bytes(held[a:b]) for held, a, b in split.records()]
        walked.append((split.begun, split.head, split.tail))
    header, cut = splits.close(walked, rule)
    return header, sorted(whole + cut)


@pytest.mark.parametrize("first", [True, False])
def test_records_come_in_runs(monkeypatch, first):
    """Whole records of many blocks at once, also where one is longer than a run, or ends with the bytes that are held."""
    monkeypatch.setattr(splits, "RUN", 1000)
    rows = _many_rows(200)
    rows[90] |= {"sequence": "A" * 3000, "quality": None}
    records = [bam.write_record(r, {"chr1": 0, "chr2": 1}) for r in rows]
    data = (b"BAM\x01" + bytes(8) if first else b"") + b"".join(records)
    for size in (50, len(data) // 2, len(data)):
        split = splits.Split([data[i : i + size] for i in range(0, len(data), size)] + [b""], bam.RULE, first)
        runs = [(bytes(held), list(edges)) for held, edges in split.runs()]
        found = [held[a:b] for held, edges in runs for a, b in zip(edges, edges[1:])]
        begun = len(records) - len(found)
        assert found == records[begun:] and split.tail == b"" and split.head == (data[:12] if first else b"".join(records[:begun]))
        assert len(runs) <= len(data) / 1000 + 2


@pytest.mark.parametrize("size", [33, 150, 1000])
def test_borders_at_every_block(size):
    """Blocks smaller than headers and records, a record over many blocks, tags that look like records; any border, every border."""
    row = {"name": "r", "flags": 0, "reference": "chr1", "position": 5, "mapq": 60, "cigar": "8M", "mate_reference": None, "mate_position": None, "template_length": 0, "sequence": "ACGTACGT", "quality": None, "tags": {"NM": "i:0"}}
    inner = bam.write_record(row, {"chr1": 0})
    hidden = {"XB": "B:C," + ",".join(map(str, inner * 2)), "XZ": "Z:" + "after" * 20}
    rows = [row | {"name": f"r{i}", "sequence": "ACGTACGT" * n, "cigar": f"{8 * n}M", "tags": hidden if i % 7 == 3 else {"NM": f"i:{i}"}} for i, n in enumerate([1, 2, 300, 1, 1, 40, 3, 5] * 4)]
    records = [bam.write_record(r, {"chr1": 0}) for r in rows]
    head = b"BAM\x01" + struct.pack("<i", 300) + b"x" * 300 + struct.pack("<ii", 1, 5) + b"chr1\0" + struct.pack("<i", 99)
    data = head + b"".join(records)
    blocks = [data[i : i + size] for i in range(0, len(data), size)]
    for border in range(1, len(blocks)):
        assert _cut(blocks, [border], bam.RULE) == (head, sorted(records))
    for step in (len(blocks) // 3, len(blocks) // 7):
        assert _cut(blocks, range(step, len(blocks), step), bam.RULE) == (head, sorted(records))
    # What can't be told from records at all is refused, not read wrongly.
    last = bam.write_record(row | {"tags": {"XB": hidden["XB"]}}, {"chr1": 0})
    like = [(head + last * 5)[i : i + size] for i in range(0, len(head + last * 5), size)]
    for border in range(1, len(like)):
        try:
            assert _cut(like, [border], bam.RULE) == (head, [last] * 5)
        except ValueError as refused:
            assert "maxPartitionBytes" in str(refused)
    with pytest.raises(ValueError):
        _cut(blocks[:-1], [len(blocks) // 2], bam.RULE)
    with pytest.raises(ValueError):
        _cut(blocks[: len(blocks) // 2] + blocks[len(blocks) // 2 + 1 :], [len(blocks) // 2], bam.RULE)


def _many_rows(n):
    """Records of every kind: absent values, lengths from none on, letters in both cases, all tag types in any order, bins of all levels."""
    pick = random.Random(7)
    ends = [-(1 << 31), -32769, -129, -1, 0, 127, 128, 40_000, (1 << 31) - 1, 1 << 31, (1 << 32) - 1]
    kinds = [lambda: f"i:{pick.choice(ends)}", lambda: f"i:{pick.randrange(99)}", lambda: "Z:" + "é|x:" * pick.randrange(3), lambda: "A:!", lambda: "H:1AE3", lambda: f"f:{pick.random():.3f}", lambda: "B:s,1,-2", lambda: "B:f,1.5", lambda: "B:C,0,255"]
    rows = []
    for i in range(n):
        length = pick.randrange(9)
        tags = {f"{pick.choice('XYZa')}{pick.choice('AB0')}": pick.choice(kinds)() for _ in range(pick.randrange(6))}
        cigar = "".join(f"{pick.choice([1, 8, 20_000, 3_000_000])}{c}" for c in pick.sample(bam.OPS, pick.randrange(5))) or pick.choice(["*", None, ""])
        rows.append({
            "name": pick.choice(["", "é"]) + f"r{i}", "flags": pick.choice([0, 65_535]), "reference": pick.choice([None, "chr1", "chr2"]), "position": pick.choice([None, -1, 0, 16_383, 131_071, 500_000_000]), "mapq": pick.choice([None, 0, 254]), "cigar": cigar,
            "mate_reference": pick.choice([None, "chr2"]), "mate_position": pick.choice([None, 0, 7]), "template_length": pick.choice([None, -5, 9]), "sequence": pick.choice(["", None]) if not length else "".join(pick.choices(bam.BASES + "acgtn.", k=length)),
            "quality": pick.choice([None, "".join(pick.choices("!5I~", k=length))]), "tags": pick.choice([None, {}, tags, tags]),
        })
    return rows


def _batch(rows):
    listed = [r | {"tags": None if r["tags"] is None else list(r["tags"].items())} for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in listed], t) for c, t in zip(bam._NAMES, bam._TYPES)], bam._NAMES)


def _refuse(*_):
    raise AssertionError("a usual record was left to the code of one record")


@pytest.mark.parametrize("n", [1, 2000])
def test_bam_many_records(monkeypatch, n):
    """Many records at once are what each is by itself, in bytes and in columns."""
    rows, ids = _many_rows(n), {"chr1": 0, "chr2": 1}
    each = [bam.write_record(r, ids) for r in rows]
    edges = [0, *accumulate(map(len, each))]
    want = [bam.read_record(r[4:], list(ids)) for r in each]
    one = {f: getattr(bam, f) for f in ("write_record", "read_record")}
    for f in one:
        monkeypatch.setattr(bam, f, _refuse)
    assert bam.write_many(_batch(rows), ids) == b"".join(each)
    assert bam.write_many(_batch(_many_rows(1) + rows).slice(1), ids) == b"".join(each)
    got = bam.read_many(b"".join(each), edges, list(ids))
    assert [c.type for c in got] == bam._TYPES
    assert list(zip(*(c.to_pylist() for c in got))) == want
    for f in one:
        monkeypatch.setattr(bam, f, one[f])
    # What is unusual, or wrong, in one of them is as it is in one alone.
    for change in ({"sequence": "é", "quality": None}, {"tags": {"XA": "i:+5"}}, {"cigar": "1M1I" * 33_000}):
        odd = [*rows[:3], rows[0] | change]
        made = bam.write_many(_batch(odd), ids)
        assert made == b"".join(bam.write_record(r, ids) for r in odd)
        at = [*edges[: min(3, n) + 1], len(made)]
        assert list(zip(*(c.to_pylist() for c in bam.read_many(made, at, list(ids))))) == [*want[: min(3, n)], bam.read_record(made[at[-2] + 4 :], list(ids))]
    for change in ({"reference": "chr9"}, {"sequence": "AC", "quality": "I"}, {"sequence": "A", "quality": " "}, {"mapq": 256}, {"cigar": "M"}, {"tags": {"XA": "i:0x1"}}, {"tags": {"XA": "i:4294967296"}}, {"tags": {"XA": "q:1"}}, {"name": "n" * 255}, {"flags": None}, {"position": 1_000_000_000, "cigar": "1M"}):
        with pytest.raises((ValueError, KeyError, struct.error)):
            bam.write_many(_batch([*rows, rows[0] | change]), ids)
    for broken in (b"XAi\0\0\0", b"XAZopen", b"XAq\0", b"XAA1XAA1", b"XA", b"XABs\2\0\0\0\0\0", b"XAZ\xff\0"):
        data = each[0][: -len(bam.write_tags(rows[0]["tags"] or {})) or None] + broken
        data = struct.pack("<i", len(data) - 4) + data[4:]
        with pytest.raises((ValueError, IndexError, struct.error)):
            bam.read_many(data + each[0], [0, len(data), len(data) + len(each[0])], list(ids))


def test_bam_long_cigar():
    row = {"name": "n", "flags": 0, "reference": "chr1", "position": 0, "mapq": 3, "cigar": "1M1I" * 35_000, "mate_reference": None, "mate_position": None, "template_length": 0, "sequence": "A" * 70_000, "quality": None, "tags": {}}
    got = bam.read_record(bam.write_record(row, {"chr1": 0})[4:], ["chr1"])
    assert (got[5], got[9], got[10], got[11]) == (row["cigar"], row["sequence"], None, [])
    with pytest.raises(ValueError):
        bam.write_record(row | {"quality": "I"}, {"chr1": 0})


@pytest.mark.parametrize("region", [("chr1", 0, 1), ("chr1", 16_380, 16_400), ("chr1", 60_000, 130_000), ("chr1", 199_000, 900_000_000), ("chr2", 0, 5000), ("chr9", 0, 10)])
def test_region(spark, bam_file, region):
    index = bam.parse_index(index_of(bam_file))
    with_index = {r.name for r in bam.read_bam(spark, bam_file, region, index).collect()}
    assert with_index == {r.name for r in bam.read_bam(spark, bam_file, region).collect()}
    name, start, end = region
    want = {f"r{i}" for i in range(3000) if i * 60 < end and i * 60 + 49 > start} if name == "chr1" else {"v"} if name == "chr2" else set()
    assert with_index == want


def test_tabix_and_csi(spark, tmp_path):
    rows = [f"chr1\t{i * 300}\t{i * 300 + 100}\tn{i}\n".encode() for i in range(4000)]
    blocks, offsets, at = [], [], 0
    for lo in range(0, len(rows), 500):
        block, used = deflate_block(b"".join(rows[lo : lo + 500])), 0
        for r in rows[lo : lo + 500]:
            offsets.append(at << 16 | used)
            used += len(r)
        at += len(block)
        blocks.append(block)
    (tmp_path / "a.bed.gz").write_bytes(b"".join(blocks) + deflate_block(b""))
    ends, bins = [*offsets[1:], at << 16], {}
    for i, chunk in enumerate(zip(offsets, ends)):
        bins.setdefault(bam.bin_of(i * 300, i * 300 + 100), []).append(chunk)
    line = [next(offsets[i] for i in range(4000) if i * 300 + 100 > w << 14) for w in range((1_199_800 >> 14) + 1)]
    body = lambda loffset: b"".join(struct.pack("<I", b) + (struct.pack("<Q", 0) if loffset else b"") + struct.pack("<i", len(c)) + b"".join(struct.pack("<2Q", *x) for x in c) for b, c in bins.items())
    head = struct.pack("<7i", 0x10000, 1, 2, 3, ord("#"), 0, 5) + b"chr1\0"
    tbi = b"TBI\x01" + struct.pack("<i", 1) + head + struct.pack("<i", len(bins)) + body(False) + struct.pack(f"<i{len(line)}Q", len(line), *line)
    csi = b"CSI\x01" + struct.pack("<3i", 14, 5, len(head)) + head + struct.pack("<2i", 1, len(bins)) + body(True)
    (tmp_path / "a.tbi").write_bytes(deflate_block(tbi[:60_000]) + deflate_block(tbi[60_000:]) + deflate_block(b""))
    (tmp_path / "a.csi").write_bytes(deflate_block(csi[:60_000]) + deflate_block(csi[60_000:]) + deflate_block(b""))
    for name in ("a.tbi", "a.csi"):
        index = bam.read_index(spark, str(tmp_path / name))
        assert index.names == ["chr1"]
        for start, end in ((0, 50), (16_300, 16_500), (500_000, 700_000)):
            lines = bam.region_lines(spark, str(tmp_path / "a.bed.gz"), index, "chr1", start, end).select(F.split("line", "\t").alias("c"))
            near = {r[0] for r in lines.where((F.col("c")[1].cast("int") < end) & (F.col("c")[2].cast("int") > start)).select(F.col("c")[3]).collect()}
            assert near == {f"n{i}" for i in range(4000) if i * 300 < end and i * 300 + 100 > start}
    tbi, csi = (bam.read_index(spark, str(tmp_path / n)) for n in ("a.tbi", "a.csi"))
    assert csi.query("chrX", 0, 9) == []
    for bad in (("chrX", 0, 9), ("chr1", 9, 9)):
        with pytest.raises(ValueError):
            tbi.query(*bad)


def test_genbank(spark, tmp_path):
    text = """LOCUS       T1   12 bp    DNA     circular SYN 01-JAN-2020
DEFINITION  A made-up
            plasmid.
ACCESSION   T1
VERSION     T1.1
KEYWORDS    one; two.
SOURCE      made up
  ORGANISM  Nomen nescio
            Bacteria; Fictio.
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Nomen nescio"
                     /pseudo
     CDS             join(1..3,
                     7..9)
                     /gene="g"
ORIGIN
        1 ACGTAC
        7 GTACGT
//
LOCUS       T2   3 bp    RNA     linear SYN
ORIGIN
        1 acg
//
"""
    (tmp_path / "a.gb").write_text(text)
    one, two = genbank.read_genbank(spark, str(tmp_path / "a.gb")).orderBy("locus").collect()
    assert (one.length, one.topology, one.date, one.definition, one.keywords, one.organism, one.taxonomy) == (12, "circular", "01-JAN-2020", "A made-up plasmid.", ["one", "two"], "Nomen nescio", ["Bacteria", "Fictio"])
    assert [(f.key, f.location, [tuple(q) for q in f.qualifiers]) for f in one.features] == [("source", "1..12", [("organism", "Nomen nescio"), ("pseudo", "")]), ("CDS", "join(1..3, 7..9)", [("gene", "g")])]
    assert (one.sequence, two.sequence, two.date, two.features) == ("acgtacgtacgt", "acg", "", [])
    (tmp_path / "b.gb").write_text("LOCUS x\n//\n")
    with pytest.raises(Exception):
        genbank.read_genbank(spark, str(tmp_path / "b.gb")).collect()


def test_fai(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a x\nACGT\nACGT\nAC\n>b\nTT\n")
    index = fai.build_fai(spark, str(tmp_path / "a.fa"))
    assert index.select(writers.fai_lines(index)).toPandas().iloc[:, 0].tolist() == ["a\t10\t5\t4\t5", "b\t2\t21\t2\t3"]
    assert index.where("name = 'a'").select(fai.byte_offset(F.lit(6))).first()[0] == 12
    fasta = readers.read_fasta(spark, str(tmp_path / "a.fa"))
    assert fai.fetch_region(fasta, "a", 3, 99).first().sequence == "TACGTAC"
    for bad in ((3, 3), (10, 12)):
        with pytest.raises(Exception):
            fai.fetch_region(fasta, "a", *bad).collect()


def test_text_writers(spark, sam, tmp_path):
    writers.write_lines(sam, writers.sam_lines(sam), str(tmp_path / "sam"))
    assert readers.read_sam(spark, str(tmp_path / "sam")).select("name", "flags", "position", "cigar", "quality", "mate_reference").exceptAll(sam.select("name", "flags", "position", "cigar", "quality", "mate_reference")).count() == 0
    paf, blast = "q\t10\t0\t9\t+\tt\t20\t1\t10\t9\t9\t60", "q\ts\t99.50\t100\t1\t0\t1\t100\t5\t104\t0.001\t180.5"
    graph = ["H\tVN:Z:1.0", "S\ts1\tACGT\tKC:i:5\tLN:i:4", "L\ts1\t+\ts1\t-\t0M", "P\tp\ts1+,s1-\t*"]
    for name, text in (("paf", paf), ("blast", blast), ("gfa", "\n".join(graph))):
        (tmp_path / name).write_text(text + "\n")
    p, b = readers.read_paf(spark, str(tmp_path / "paf")), readers.read_blast(spark, str(tmp_path / "blast"))
    assert p.select(writers.paf_lines(p)).first()[0] == paf and b.select(writers.blast_lines(b)).first()[0] == blast.replace("0.001", "0.001")
    g = readers.read_gfa(spark, str(tmp_path / "gfa"))
    assert [r.line for r in writers.gfa_lines(g["segments"], g["links"], g["paths"]).collect()] == graph


HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=LowQual,Description="Low, really">
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">
##INFO=<ID=DB,Number=0,Type=Flag,Description="Known">
##INFO=<ID=AF,Number=A,Type=Float,Description="Share">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">
##contig=<ID=chr1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
"""


def test_bcf_equals_vcf(spark, tmp_path):
    text = lambda s: bytes([len(s) << 4 | 7]) + s.encode()
    number = lambda v: bytes([0x11, v])
    long = "A" * 20
    shared = [
        struct.pack("<iiIfHHI", 0, 6, 1, 30.5, 3, 3, 2 << 24 | 2) + b"\x07" + text("G") + text("C") + text("T") + number(0) + number(2) + b"\x12" + struct.pack("<h", 300) + number(3) + b"\x00" + number(4) + b"\x25" + struct.pack("<fI", 0.25, 0x7F800001),
        struct.pack("<iiIIHHI", 0, 9, 20, 0x7F800001, 0, 2, 2 << 24 | 2) + text("rs1") + b"\xf7" + number(20) + long.encode() + text("A") + number(1),
    ]
    own = [number(5) + b"\x21" + bytes([2, 5, 2, 4]) + number(2) + b"\x11" + bytes([9, 128]), number(5) + b"\x21" + bytes([0, 0, 4, 129]) + number(2) + b"\x11" + bytes([1, 2])]
    head = b"BCF\x02\x02" + struct.pack("<I", len(HEADER) + 1) + HEADER.encode() + b"\0"
    body = b"".join(struct.pack("<II", len(s), len(o)) + s + o for s, o in zip(shared, own))
    (tmp_path / "a.bcf").write_bytes(deflate_block(head + body) + deflate_block(b""))
    (tmp_path / "a.vcf").write_text(HEADER + f"chr1\t7\t.\tG\tC,T\t30.5\tPASS\tDP=300;DB;AF=0.25,.\tGT:DP\t0|1:9\t0/1:.\nchr1\t10\trs1\t{long}\tA\t.\tLowQual\t.\tGT:DP\t./.:1\t1:2\n")
    got, want = bcf.read_bcf(spark, str(tmp_path / "a.bcf")), readers.read_vcf(spark, str(tmp_path / "a.vcf"))
    assert got.columns == want.columns
    assert [r.asDict() for r in got.orderBy("pos").collect()] == [r.asDict() for r in want.orderBy("pos").collect()]
    data = head + body * 9
    for size in (5, 33, 200):
        blocks = [data[i : i + size] for i in range(0, len(data), size)]
        want = sorted([body[: len(shared[0] + own[0]) + 8], body[len(shared[0] + own[0]) + 8 :]] * 9)
        for border in range(1, len(blocks)):
            assert _cut(blocks, [border], bcf.RULE) == (head, want)
        assert _cut(blocks, range(1, len(blocks)), bcf.RULE) == (head, want)
    (tmp_path / "b.bcf").write_bytes(deflate_block(head + body[:-1]) + deflate_block(b""))
    with pytest.raises(Exception):
        bcf.read_bcf(spark, str(tmp_path / "b.bcf")).collect()


def test_vcf_header(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(HEADER)
    found = {(r.kind, r.id): r for r in bcf.vcf_header(spark, str(tmp_path / "a.vcf")).collect()}
    assert len(found) == 8 and found["fileformat", None].value == "VCFv4.2" and found["contig", "chr1"].length == 1000
    assert found["FILTER", "LowQual"].description == "Low, really" and (found["INFO", "AF"].number, found["INFO", "AF"].type) == ("A", "Float")
