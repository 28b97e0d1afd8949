"""Range coders against encoders written here, and reference-compressed files made here record by record."""

import bz2
import gzip
import hashlib
import lzma
import random
import struct
import zlib

import pytest

from helixframe.sources import cram, rans


def scaled(counts, bits):
    total, out = sum(counts.values()), {}
    for s, c in counts.items():
        out[s] = max(1, c * ((1 << bits) - len(counts)) // total)
    out[max(out, key=out.get)] += (1 << bits) - sum(out.values())
    return out


def tally(pairs):
    out = {}
    for context, s in pairs:
        out.setdefault(context, {}).setdefault(s, 0)
        out[context][s] += 1
    return out


def listed(symbols, body):
    out, run = b"", 0
    for i, s in enumerate(symbols):
        if run:
            run -= 1
        else:
            out += bytes([s])
            if i and symbols[i - 1] == s - 1:
                while symbols[i + run + 1 : i + run + 2] == [s + run + 1]:
                    run += 1
                out += bytes([run])
        out += body(s)
    return out + b"\0"


def seven(n):
    out = bytes([n & 127])
    while n := n >> 7:
        out = bytes([n & 127 | 128]) + out
    return out


def path_of(data, ways, order):
    """(way, place, context) as the decoder goes."""
    if not order:
        return [(i % ways, i, None) for i in range(len(data))]
    part = len(data) // ways
    places = [(i % ways, i // ways + i % ways * part) for i in range(part * ways)] + [(ways - 1, i) for i in range(part * ways, len(data))]
    return [(w, p, 0 if p == w * part else data[p - 1]) for w, p in places]


def coded(data, ways, order, bits, low, step, tables):
    states, out = [low] * ways, []
    for way, place, context in reversed(path_of(data, ways, order)):
        table = tables[context]
        f, c, x = table[data[place]], sum(n for s, n in table.items() if s < data[place]), states[way]
        while x >= ((low >> bits) << 8 * step) * f:
            out.append((x & (1 << 8 * step) - 1).to_bytes(step, "little"))
            x >>= 8 * step
        states[way] = (x // f << bits) + x % f + c
    return struct.pack(f"<{ways}I", *states) + b"".join(reversed(out))


def encode_4x8(data, order):
    tables = {k: scaled(v, 12) for k, v in tally((c, data[p]) for _, p, c in path_of(data, 4, order)).items()}
    count = lambda f: bytes([f]) if f < 128 else bytes([f >> 8 | 128, f & 255])
    one = lambda table: listed(sorted(table), lambda s: count(table[s] & 4095))
    head = listed(sorted(tables), lambda c: one(tables[c])) if order else one(tables[None])
    body = head + coded(data, 4, order, 12, 1 << 23, 1, tables)
    return struct.pack("<BII", order, len(body), len(data)) + body


def encode_16(data, order=0, wide=False, packed_table=False):
    ways = 32 if wide else 4
    tables = {k: scaled(v, 12) for k, v in tally((c, data[p]) for _, p, c in path_of(data, ways, order)).items()}
    if not order:
        table = tables[None]
        head = listed(sorted(table), lambda s: b"") + b"".join(seven(table[s]) for s in sorted(table))
    else:
        letters = sorted(set(data) | set(tables))
        head = listed(letters, lambda s: b"")
        for c in letters:
            skip = 0
            for i, s in enumerate(letters):
                if skip:
                    skip -= 1
                    continue
                head += seven(tables.get(c, {}).get(s, 0))
                if not tables.get(c, {}).get(s):
                    while i + skip + 1 < len(letters) and not tables.get(c, {}).get(letters[i + skip + 1]):
                        skip += 1
                    head += bytes([skip])
        if packed_table:
            inner = encode_16(head)
            inner = inner[1 + len(seven(len(head))) :]
            head = bytes([12 << 4 | 1]) + seven(len(head)) + seven(len(inner)) + inner
        else:
            head = bytes([12 << 4]) + head
    return bytes([order | (rans.WIDE if wide else 0)]) + seven(len(data)) + head + coded(data, ways, order, 12, 1 << 15, 2, tables)


DATA = [b"a", b"abc", b"aaaa" * 100, bytes(random.Random(1).choices(b"ACGTN!\0\1\2\3", k=3001)), bytes(random.Random(2).choices(range(256), k=999))]


@pytest.mark.parametrize("data", DATA, ids=range(len(DATA)))
def test_range_coders(data):
    for order in (0, 1):
        assert rans.decode_4x8(encode_4x8(data, order)) == data
        for wide in (False, True):
            assert rans.decode_16(encode_16(data, order, wide)) == data
    assert rans.decode_16(encode_16(data, 1, packed_table=True)) == data
    assert rans.decode_16(bytes([rans.NO_SIZE | rans.PLAIN]) + data, len(data)) == data


def test_range_coder_transforms():
    text = b"AAAAACCCGTTTTTTTTTTTTA" * 3
    stripes = [encode_16(text[i::3]) for i in range(3)]
    assert rans.decode_16(bytes([rans.STRIPE]) + seven(len(text)) + bytes([3]) + b"".join(seven(len(s)) for s in stripes) + b"".join(stripes)) == text
    letters = b"ACGT"
    codes = [letters.index(b) for b in text] + [0, 0, 0]
    packed = bytes(codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, len(text), 4))
    assert rans.decode_16(bytes([rans.PACK | rans.PLAIN]) + seven(len(text)) + bytes([4]) + letters + seven(len(packed)) + packed) == text
    assert rans.decode_16(bytes([rans.PACK | rans.PLAIN]) + seven(9) + b"\1Z" + seven(0)) == b"Z" * 9
    literals, meta, i = b"", bytes([2]) + b"AT", 0
    while i < len(text):
        n = 1
        while text[i] in b"AT" and text[i : i + n + 1] == text[i : i + 1] * (n + 1):
            n += 1
        literals, meta, i = literals + text[i : i + 1], meta + (seven(n - 1) if text[i] in b"AT" else b""), i + n
    assert rans.decode_16(bytes([rans.RUNS | rans.PLAIN]) + seven(len(text)) + seven(len(meta) << 1 | 1) + seven(len(literals)) + meta + literals) == text
    inner = encode_16(meta)[1 + len(seven(len(meta))) :]
    assert rans.decode_16(bytes([rans.RUNS | rans.PLAIN]) + seven(len(text)) + seven(len(meta) << 1) + seven(len(literals)) + seven(len(inner)) + inner + literals) == text
    with pytest.raises(ValueError):
        rans.decode_16(bytes([rans.PLAIN]) + seven(5) + b"ab")


def itf8(n):
    n &= 0xFFFFFFFF
    for more, top in enumerate((7, 14, 21, 28)):
        if n < 1 << top:
            return ((0xFF00 >> more & 0xFF) << 8 * more | n).to_bytes(more + 1, "big")
    return bytes([0xF0 | n >> 28]) + (n >> 4 & 0xFFFFFF).to_bytes(3, "big") + bytes([n & 15])


def ltf8(n):
    more = next((i for i in range(8) if n < 1 << 7 * (i + 1)), 8)
    return ((0xFF00 >> more & 0xFF) << 8 * more | n).to_bytes(more + 1, "big") if more < 8 else b"\xff" + n.to_bytes(8, "big")


def array(values):
    return itf8(len(values)) + b"".join(map(itf8, values))


def block(kind, number, data, method=0):
    body = {0: lambda: data, 1: lambda: gzip.compress(data), 2: lambda: bz2.compress(data), 3: lambda: lzma.compress(data), 4: lambda: encode_4x8(data, 1), 5: lambda: encode_16(data, 1)}[method if data else 0]()
    out = bytes([method if data else 0, kind]) + itf8(number) + itf8(len(body)) + itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out))


def container(body, reference=0, start=0, span=0, records=0, marks=(), blocks=1):
    head = struct.pack("<i", len(body)) + itf8(reference) + itf8(start) + itf8(span) + itf8(records) + ltf8(0) + ltf8(0) + itf8(blocks) + array(marks)
    return head + struct.pack("<I", zlib.crc32(head)) + body


END = container(block(1, 0, b"\1\0\1\0\1\0"), -1, 4542278)
NUMBERS = ["BF", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "NF", "TL", "FN", "FP", "DL", "RS", "HC", "PD", "MQ", "RI"]
BYTES = ["FC", "BA", "BS", "QS"]
TEXTS = ["RN", "IN", "SC", "BB", "QQ"]
LINES = [[], [b"NMC", b"XZZ"]]
IDS = {name: 10 + i for i, name in enumerate(NUMBERS + BYTES + TEXTS)}


def encoding(kind, params):
    return itf8(kind) + itf8(len(params)) + params


def compression(names=True, differences=True, needed=True):
    matrix = bytes([0b00011011] * 5)
    lines = b"".join(b"".join(line) + b"\0" for line in LINES)
    kept = [b"RN" + bytes([names]), b"AP" + bytes([differences]), b"RR" + bytes([needed]), b"SM" + matrix, b"TD" + itf8(len(lines)) + lines]
    series = [n.encode() + encoding(1, itf8(IDS[n])) for n in NUMBERS + BYTES]
    series += [n.encode() + encoding(5, b"\0" + itf8(IDS[n])) for n in TEXTS]
    series.append(b"CF" + encoding(6, itf8(0) + itf8(4)))  # four bits of the core block
    one = encoding(3, array([1]) + array([0]))  # a code of no bits: always 1
    tags = [itf8(int.from_bytes(b"NMC", "big")) + encoding(4, one + encoding(1, itf8(90))), itf8(int.from_bytes(b"XZZ", "big")) + encoding(5, b"\t" + itf8(91))]
    maps = [kept, series, tags]
    return b"".join(itf8(len(itf8(len(m)) + b"".join(m))) + itf8(len(m)) + b"".join(m) for m in maps)


class Writer:
    def __init__(self):
        self.outer, self.core = {}, []

    def put(self, **values):
        for name, v in values.items():
            if name == "CF":
                self.core += [v >> 3 - i & 1 for i in range(4)]
            else:
                data = itf8(v) if name in NUMBERS else v + b"\0" if name in TEXTS else v if isinstance(v, bytes) else bytes([v])
                self.raw(IDS[name], data)

    def raw(self, number, data):
        self.outer[number] = self.outer.get(number, b"") + data

    def slice(self, reference, start, span, records, digest=b"\0" * 16, counter=0, embedded=None):
        bits = self.core + [0] * (-len(self.core) % 8)
        core = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        if embedded:
            self.outer[99] = embedded
        blocks = [block(5, 0, core)] + [block(4, n, d, i % 6) for i, (n, d) in enumerate(sorted(self.outer.items()))]
        head = itf8(reference) + itf8(start) + itf8(span) + itf8(records) + ltf8(counter) + itf8(len(blocks)) + array(list(self.outer)) + itf8(99 if embedded else -1) + digest
        return block(2, 0, head) + b"".join(blocks)


GENOME = {n: "".join(random.Random(n).choices("ACGT", k=200_000)) for n in ("chr1", "chr2")}
HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:200000\n@SQ\tSN:chr2\tLN:200000\n@RG\tID:lane1\n@RG\tID:lane2\n"


def file_of(*parts):
    """A file of (compression, slices, reference) containers."""
    text = HEADER.encode()
    out = b"CRAM\3\0" + b"x" * 20 + container(block(0, 0, struct.pack("<i", len(text)) + text, 1))
    for head, slices, reference, records in parts:
        first = block(1, 0, head)
        marks, at = [], len(first)
        for s in slices:
            marks.append(at)
            at += len(s)
        out += container(first + b"".join(slices), reference, records=records, marks=marks)
    return out + END


def mapped():
    """One slice on chr1 over a border of the reference's pieces: mates by place, a detached one, all kinds of differences."""
    ref, w = GENOME["chr1"], Writer()
    start = 65_500
    other = {b: "ACGTN".replace(b, "") for b in "ACGT"}
    w.put(BF=0x1 | 0x40, CF=4 | 1, RL=60, AP=0, RG=0, RN=b"pair", NF=1, TL=1, FN=0, MQ=60, QS=bytes(range(60)))
    w.raw(90, b"\3"), w.raw(91, b"hello\0\t")
    w.put(BF=0, CF=2, RL=30, AP=10, RG=-1, RN=b"lone", MF=1, NS=1, NP=77, TS=-5, TL=0, FN=9, MQ=255)
    for code, step, value in [("H", 1, ("HC", 4)), ("S", 0, ("SC", b"GG")), ("X", 4, ("BS", 2)), ("I", 3, ("IN", b"TTT")), ("D", 5, ("DL", 7)), ("i", 2, ("BA", b"C")), ("N", 4, ("RS", 100)), ("b", 3, ("BB", b"NNA")), ("Q", 6, ("QS", b"\7"))]:
        w.put(FC=ord(code), FP=step, **dict([value]))
    w.put(BF=0x1 | 0x10 | 0x80, CF=0, RL=20, AP=40, RG=1, RN=b"pair", TL=0, FN=2, MQ=3)
    w.put(FC=ord("B"), FP=1, BA=b"T", QS=9)
    w.put(FC=ord("P"), FP=5, PD=2)
    p = start - 1
    q = p + 10
    at = q  # 2S, then matches up to place 5
    lone = "GG" + ref[at : at + 2]
    lone += other[ref[at + 2]][2] + ref[at + 3 : at + 5] + "TTT" + ref[at + 5 : at + 7]  # X at 5, I at 8
    at += 7 + 7  # D at 13, after two matches
    lone += ref[at : at + 2] + "C" + ref[at + 2 : at + 5]  # i at 15, N at 19
    at += 5 + 100
    lone += ref[at : at + 3] + "NNA" + ref[at + 6 : at + 12]  # b at 22, up to place 30
    second = p + 50
    scores = [0] * 30
    scores[27] = 7
    want = [
        ("pair", 0x1 | 0x40 | 0x20, "chr1", p, 60, "60M", "chr1", second, 70, ref[p : p + 60], "".join(chr(33 + i) for i in range(60)), {"NM": "i:3", "XZ": "Z:hello", "RG": "Z:lane1"}),
        ("lone", 0x20, "chr1", q, None, "4H2S5M3I2M7D2M1I3M100N12M", "chr2", 76, -5, lone, "".join(chr(33 + i) for i in scores), {}),
        ("pair", 0x1 | 0x10 | 0x80, "chr1", second, 3, "5M2P15M", "chr1", p, -70, "T" + ref[second + 1 : second + 20], "*" + "!" * 19, {"RG": "Z:lane2"}),
    ]
    return w, start, want


def plain(df):
    return sorted((tuple(r)[:-1] + (tuple(sorted((r.tags or {}).items())),) for r in df.collect()), key=str)


def as_rows(want):
    return sorted((r[:-1] + (tuple(sorted(r[-1].items())),) for r in want), key=str)


def references(spark):
    return spark.createDataFrame([(n + " of tests", s.lower()) for n, s in GENOME.items()], "id string, sequence string")


def test_numbers():
    for n in (0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**31 - 1, -1, -5, -(2**31)):
        assert cram.itf8(rans.Bytes(itf8(n))) == n
    for n in [0, *(2**i + d for i in range(1, 63) for d in (-1, 0, 1))]:
        assert cram.ltf8(rans.Bytes(ltf8(n))) == n


def test_encodings():
    def made(kind, params, bits):
        bits += "0" * (-len(bits) % 8)
        return cram.Encoding(rans.Bytes(encoding(kind, params))), cram.Streams([cram.Block(5, 0, int(bits, 2).to_bytes(len(bits) // 8, "big"))])

    gamma, s = made(9, itf8(1), "1" + "010" + "00101")
    assert [gamma.number(s) for _ in range(3)] == [0, 1, 4]
    subexp, s = made(7, itf8(0) + itf8(2), "011" + "1001" + "110101")
    assert [subexp.number(s) for _ in range(3)] == [3, 5, 13]
    huffman, s = made(3, array([7, 8, 9]) + array([1, 2, 2]), "0" + "10" + "11" + "0")
    assert [huffman.number(s) for _ in range(4)] == [7, 8, 9, 7]


def test_cram(spark, tmp_path):
    w, start, want = mapped()
    span = 400
    digest = hashlib.md5(GENOME["chr1"][start - 1 : start - 1 + span].encode()).digest()
    one = w.slice(0, start, span, 3, digest)
    # Reads of both references in one slice, places not as differences; then reads without a place, and names that aren't kept.
    m = Writer()
    for which, at in ((0, 100), (1, 131_060), (-1, 0)):
        m.put(BF=4 if which < 0 else 0, CF=0, RI=which, RL=40, AP=at, RG=-1, RN=b"m%d" % which, TL=0)
        m.put(**({"BA": b"ACGTN" * 8} if which < 0 else {"FN": 0, "MQ": 1}))
        if which >= 0:
            want.append((f"m{which}", 0, f"chr{which + 1}", at - 1, 1, "40M", None, None, 0, GENOME[f"chr{which + 1}"][at - 1 : at + 39], None, {}))
    want.append(("m-1", 4, None, None, None, "*", None, None, 0, "ACGTN" * 8, None, {}))
    u = Writer()
    u.put(BF=4, CF=8, RL=0, AP=0, RG=-1, TL=0)
    u.put(BF=4, CF=1, RL=3, AP=0, RG=-1, TL=0, BA=b"ACG", QS=b"\xff\xff\xff")
    want += [("1000001", 4, None, None, None, "*", None, None, 0, None, None, {}), ("1000002", 4, None, None, None, "*", None, None, 0, "ACG", None, {})]
    data = file_of((compression(), [one], 0, 3), (compression(differences=False), [m.slice(-2, 0, 0, 3)], -2, 3), (compression(names=False), [u.slice(-1, 0, 0, 2, counter=10**6)], -1, 2))
    (tmp_path / "a.cram").write_bytes(data)
    path = str(tmp_path / "a.cram")
    got = cram.read_cram(spark, path, references(spark))
    assert plain(got) == as_rows(want)
    # Without the reference all but the bases are the same.
    bare = {r.name + str(r.flags): r for r in cram.read_cram(spark, path).collect()}
    assert bare["pair97"].sequence == "N" * 60 and bare["lone32"].cigar == want[1][5] and bare["m-14"].sequence == "ACGTN" * 8
    with pytest.raises(Exception, match="isn't the one"):
        cram.read_cram(spark, path, spark.createDataFrame([("chr1", "A" * 200_000)], "id string, sequence string")).collect()
    for broken, says in [(data[: -len(END)], "cut off"), (data[:200] + bytes([data[200] ^ 1]) + data[201:], "checksum|CRC|block|cut"), (b"BAM\1" + data[4:], "not a CRAM")]:
        (tmp_path / "b.cram").write_bytes(broken)
        with pytest.raises(Exception, match=says):
            cram.read_cram(spark, str(tmp_path / "b.cram")).collect()


def test_embedded_reference():
    w, start, want = mapped()
    own = GENOME["chr1"][start - 1 : start + 399].encode()
    data = file_of((compression(), [w.slice(0, start, 400, 3, embedded=own)], 0, 3))
    (head, part, names, groups, wants) = next(cram.slices_of(data))
    assert not wants and names == ["chr1", "chr2"] and groups == ["lane1", "lane2"]
    rows = [cram._row(r, names, groups) for r in cram.read_slice(head, part, lambda *_: None)]
    assert [r[:-1] + (dict(r[-1]),) for r in rows] == want
