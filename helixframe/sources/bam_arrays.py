"""Many alignment records at once, as arrays of their bytes. What these don't cover is ``Unusual`` and left to ``bam``'s code of one record."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the format: base letters and operation letters.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: The part of a record that has fixed places, after its size.
_FIXED = np.dtype([("reference", "<i4"), ("position", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flags", "<u2"), ("l_seq", "<i4"), ("mate", "<i4"), ("mate_position", "<i4"), ("template_length", "<i4")])
_SIZED = np.dtype([("size", "<i4"), *_FIXED.descr])
_LETTERS = np.frombuffer(BASES.encode(), np.uint8)
_CODES = np.full(128, 15, np.uint8)
for _i, _c in enumerate(BASES):
    _CODES[[ord(_c), ord(_c.lower())]] = _i
#: Bytes of an integer by its type letter.
_WIDTHS = np.zeros(256, np.int64)
for _c, _n in zip(b"cCsSiI", (1, 1, 2, 2, 4, 4)):
    _WIDTHS[_c] = _n


class Unusual(Exception):
    """Records that the arrays don't cover, or that are wrong, which the code of one record tells."""


def _need(holds: bool) -> None:
    if not holds:
        raise Unusual


def _before(lengths: np.ndarray) -> np.ndarray:
    """The sum of the lengths before each."""
    return np.cumsum(lengths) - lengths


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    return np.repeat(starts - _before(lengths), lengths) + np.arange(lengths.sum())


def _chars(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and bytes of strings; a null is empty."""
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at or b"", np.int64)[column.offset : column.offset + len(column) + 1]
    return at[:-1], np.diff(at), np.frombuffer(data or b"", np.uint8)


def _strings(data: np.ndarray, lengths: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Strings of these lengths out of their bytes."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    _need(ends[-1] < 1 << 31)
    valid = None if absent is None else pa.py_buffer(np.packbits(~absent, bitorder="little"))
    out = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data, np.uint8)), valid)
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        raise Unusual from None
    return out


def _numbers(column: pa.Array, absent: int | None, low: int, high: int) -> np.ndarray:
    _need(absent is not None or not column.null_count)
    out = (pc.fill_null(column, absent) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64)
    _need(bool(((out >= low) & (out <= high)).all()))
    return out


def _bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``bam.bin_of`` of each."""
    out = np.zeros(len(start), np.int64)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(start >> shift == (end - 1) >> shift, first + (start >> shift), out)
    return out


def written(batch: pa.RecordBatch, ids: dict[str, int], split_cigar: Callable[[str], list[str]], write_tags: Callable[[dict[str, str]], bytes]) -> bytes:
    """The records of a batch with their sizes, each as ``bam.write_record`` makes it."""
    column, n = {c: batch.column(c) for c in batch.schema.names}, batch.num_rows
    if not n:
        return b""
    int32 = (-(1 << 31), (1 << 31) - 1)
    numbers = np.array([*ids.values(), -1])

    def which(name: str) -> np.ndarray:
        found = pc.index_in(column[name], pa.array(list(ids), column[name].type))
        _need(found.null_count == column[name].null_count)
        return numbers[_numbers(found, -1, *int32)]

    position = _numbers(column["position"], -1, *int32)
    _need(not column["name"].null_count)
    name_at, name_n, name_data = _chars(column["name"])
    _need(name_n.max() < 255)

    texts = pc.fill_null(column["cigar"], "*").dictionary_encode()
    cut = [split_cigar(c) for c in texts.dictionary.to_pylist()]
    flat = np.array([int(c[:-1]) << 4 | OPS.index(c[-1]) for ops in cut for c in ops] or [0])
    many, covers = np.array([len(ops) for ops in cut]), np.array([sum(int(c[:-1]) for c in ops if c[-1] in "MDN=X") for ops in cut])
    _need(flat.max() < 1 << 32 and many.max() <= 0xFFFF)
    cigar = texts.indices.to_numpy()
    n_ops, covered = many[cigar], covers[cigar]
    ops = flat[_spans(_before(many)[cigar], n_ops)].astype("<u4").view(np.uint8)

    seq_at, seq_n, seq_data = _chars(column["sequence"])
    qual_at, qual_n, qual_data = _chars(column["quality"])
    scored = column["quality"].is_valid().to_numpy(zero_copy_only=False)
    bases, scores = seq_data[_spans(seq_at, seq_n)], qual_data[_spans(qual_at, qual_n)]
    _need((qual_n == seq_n)[scored].all() and (bases < 128).all() and ((scores >= 33) & (scores < 128)).all())

    row, tag, kind, payload, payload_n = _tags(column["tags"], write_tags)
    tags_n = np.bincount(row, 3 + payload_n, n).astype(np.int64)

    size = 33 + name_n + 4 * n_ops + (seq_n + 1) // 2 + seq_n + tags_n
    _need(size.max() <= int32[1])
    fixed = np.zeros(n, _SIZED)
    fixed["size"], fixed["l_name"], fixed["n_ops"], fixed["l_seq"], fixed["position"] = size, name_n + 1, n_ops, seq_n, position
    fixed["reference"], fixed["mate"] = which("reference"), which("mate_reference")
    fixed["mapq"], fixed["flags"] = _numbers(column["mapq"], 255, 0, 255), _numbers(column["flags"], None, 0, 0xFFFF)
    fixed["mate_position"], fixed["template_length"] = _numbers(column["mate_position"], -1, *int32), _numbers(column["template_length"], 0, *int32)
    bins = np.where(position >= 0, _bins(position, position + np.maximum(covered, 1)), 4680)
    _need(bins.max() <= 0xFFFF)
    fixed["bin"] = bins

    at = _before(4 + size)
    out = np.zeros(int((4 + size).sum()), np.uint8)
    out[at[:, None] + np.arange(36)] = fixed.view(np.uint8).reshape(n, 36)
    at = at + 36
    out[_spans(at, name_n)] = name_data[_spans(name_at, name_n)]
    at = at + name_n + 1
    out[_spans(at, 4 * n_ops)] = ops
    at = at + 4 * n_ops
    inside = _spans(np.zeros(n, np.int64), seq_n)
    place, codes, high = np.repeat(at, seq_n) + (inside >> 1), _CODES[bases], inside & 1 == 0
    out[place[high]] = codes[high] << 4
    out[place[~high]] |= codes[~high]
    at = at + (seq_n + 1) // 2
    out[_spans(at[scored], seq_n[scored])] = scores - 33
    out[_spans(at[~scored], seq_n[~scored])] = 255
    at = at + seq_n
    if len(row):
        before = _before(3 + payload_n)
        first = np.searchsorted(row, row)
        at = at[row] + before - before[first]
        out[at[:, None] + np.arange(2)] = tag
        out[at + 2] = kind
        out[_spans(at + 3, payload_n)] = payload
    return out.tobytes()


def _tags(tags: pa.Array, write_tags: Callable[[dict[str, str]], bytes]) -> tuple[np.ndarray, ...]:
    """All tags by row and name: row, name's two bytes, kind as it is written, bytes of all values, and their lengths."""
    at = tags.offsets.to_numpy()
    many = np.where(tags.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    row, own = np.repeat(np.arange(len(tags)), many), pa.array(_spans(at[:-1], many))
    keys, items = tags.keys.take(own), tags.items.take(own)
    key_at, key_n, key_data = _chars(keys)
    _need(not items.null_count and (key_n == 2).all())
    tag = key_data[key_at[:, None] + np.arange(2)]
    _need((tag < 128).all())
    code = row << 16 | tag[:, 0].astype(np.int64) << 8 | tag[:, 1]
    order = np.argsort(code, kind="stable")
    _need((np.diff(code[order]) > 0).all())
    tag, items = tag[order], items.take(pa.array(order))
    item_at, item_n, data = _chars(items)
    _need((item_n >= 2).all())
    kind = data[item_at].copy()
    _need((kind < 128).all() and (data[item_at + 1] < 128).all())
    whole, closed, text = kind == ord("i"), (kind == ord("Z")) | (kind == ord("H")), kind == ord("A")
    other = np.flatnonzero(~(whole | closed | text))
    made = [write_tags({t.tobytes().decode(): items[i].as_py()})[3:] for t, i in zip(tag[other], other.tolist())]

    length = np.where(whole, 4, item_n - 2 + closed)
    length[other] = [len(m) for m in made]
    out = np.zeros(int(length.sum()), np.uint8)
    to = _before(length)
    copied = closed | text
    out[_spans(to[copied], item_n[copied] - 2)] = data[_spans(item_at[copied] + 2, item_n[copied] - 2)]
    if whole.any():
        digits = pc.utf8_slice_codeunits(items.filter(pa.array(whole)), 2)
        used_at, used_n, used = _chars(digits)
        used = used[_spans(used_at, used_n)]
        _need((((used >= 48) & (used <= 57)) | (used == 45)).all())
        try:
            value = digits.cast(pa.int64()).to_numpy()
        except pa.ArrowInvalid:
            raise Unusual from None
        _need(value.min() >= -(1 << 31) and value.max() < 1 << 32)
        kind[np.flatnonzero(whole)[value > 0x7FFFFFFF]] = ord("I")
        out[to[whole][:, None] + np.arange(4)] = (value & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)
    if made:
        out[_spans(to[other], length[other])] = np.frombuffer(b"".join(made), np.uint8)
    return row, tag, kind, out, length


def read(data: bytes, edges: list[int], names: list[str], read_tag: Callable[[bytes, int], tuple[str, str, int]]) -> list[pa.Array]:
    """The columns of records that follow one another, each with its size, from the places where they begin and the last one's end."""
    places = np.array(edges)
    start, end, n = places[:-1] + 4, places[1:], len(places) - 1
    _need((end - start >= 32).all())
    held = np.frombuffer(data, np.uint8)
    values = held[start[:, None] + np.arange(32)].view(_FIXED).ravel()
    n_ops, l_name, l_seq = (values[k].astype(np.int64) for k in ("n_ops", "l_name", "l_seq"))
    _need((l_name > 0).all() and (l_seq >= 0).all())
    name_at = start + 32
    ops_at = name_at + l_name
    seq_at = ops_at + 4 * n_ops
    qual_at = seq_at + (l_seq + 1) // 2
    tags_at = qual_at + l_seq
    _need((tags_at <= end).all())

    def number(name: str, absent: int | None = None) -> pa.Array:
        found = values[name].astype(np.int32)
        return pa.array(found, pa.int32(), mask=None if absent is None else found == absent if absent > 0 else found < 0)

    def named(name: str) -> pa.Array:
        found = values[name]
        _need(found.max() < len(names))
        return pa.array(names, pa.string()).take(pa.array(found, pa.int32(), mask=found < 0))

    name = _strings(held[_spans(name_at, l_name - 1)], l_name - 1)
    ops = held[_spans(ops_at, 4 * n_ops)].view("<u4")
    each, inverse = np.unique(ops, return_inverse=True)
    _need(bool((each & 15 < len(OPS)).all()))
    shown = [f"{v >> 4}{OPS[v & 15]}".encode() for v in each.tolist()]
    shown_n = np.array([len(s) for s in shown], np.int64)
    first = _before(n_ops)
    two = np.flatnonzero(n_ops == 2)
    # A cigar that may stand in the CG tag.
    _need(not ((ops[first[two]] == l_seq[two] << 4 | 4) & (ops[first[two] + 1] & 15 == 3)).any())
    shown_n, starts = shown_n[inverse], _before(shown_n)[inverse]
    sums = np.concatenate([[0], np.cumsum(shown_n)])
    cigar_n = sums[first + n_ops] - sums[first]
    text = np.frombuffer(b"".join(shown) + b"*", np.uint8)
    bare = n_ops == 0
    cigar_data = np.full(int(cigar_n.sum()) + int(bare.sum()), ord("*"), np.uint8)
    cigar_n = cigar_n + bare
    cigar_data[_spans(_before(cigar_n)[~bare], cigar_n[~bare])] = text[_spans(starts, shown_n)]
    cigar = _strings(cigar_data, cigar_n)

    inside = _spans(np.zeros(n, np.int64), l_seq)
    pair = held[np.repeat(seq_at, l_seq) + (inside >> 1)]
    sequence = _strings(_LETTERS[np.where(inside & 1, pair & 15, pair >> 4)], l_seq, l_seq == 0)
    absent = l_seq == 0
    absent[~absent] = held[qual_at[~absent]] == 255
    qual_n = np.where(absent, 0, l_seq)
    scores = held[_spans(qual_at, qual_n)]
    _need((scores < 95).all())
    quality = _strings(scores + 33, qual_n, absent)
    return [
        name, number("flags"), named("reference"), number("position", -1), number("mapq", 255), cigar, named("mate"), number("mate_position", -1), number("template_length"), sequence, quality,
        _read_tags(data, tags_at, end, read_tag),
    ]


def _read_tags(data: bytes, at: np.ndarray, end: np.ndarray, read_tag: Callable[[bytes, int], tuple[str, str, int]]) -> pa.Array:
    """The tags between these places as maps: the first of every record, then the second of those that have one, and so on."""
    n, held = len(at), np.frombuffer(data + bytes(4), np.uint8)
    zeros = np.append(np.flatnonzero(held == 0), len(held))
    at, rows, tags, texts = at.copy(), [], [], []
    left = np.flatnonzero(at < end)
    while len(left):
        here = at[left]
        _need((here + 3 <= end[left]).all())
        kind, value_at, width = held[here + 2], here + 3, _WIDTHS[held[here + 2]]
        closed, one = (kind == ord("Z")) | (kind == ord("H")), kind == ord("A")
        copied, whole = closed | one, width > 0
        to = value_at + width
        to[one] += 1
        to[closed] = zeros[np.searchsorted(zeros, value_at[closed])] + 1
        found = []
        if copied.any():
            body_n = to[copied] - value_at[copied] - closed[copied]
            text_at = _before(body_n + 2)
            text = np.full(int((body_n + 2).sum()), ord(":"), np.uint8)
            text[text_at] = kind[copied]
            _need((to[copied] <= end[left[copied]]).all())
            text[_spans(text_at + 2, body_n)] = held[_spans(value_at[copied], body_n)]
            found.append((np.flatnonzero(copied), _strings(text, body_n + 2)))
        if whole.any():
            bits = 8 * width[whole]
            value = held[value_at[whole][:, None] + np.arange(4)].view("<u4").ravel().astype(np.int64) & (1 << bits) - 1
            signed = kind[whole] >= ord("a")
            value -= np.where(signed & (value >> bits - 1 == 1), 1 << bits, 0)
            found.append((np.flatnonzero(whole), pc.binary_join_element_wise("i", pa.array(value).cast(pa.string()), ":")))
        other = np.flatnonzero(~(copied | whole))
        if len(other):
            read = [read_tag(data, int(p)) for p in here[other]]
            to[other] = [r[2] for r in read]
            found.append((other, pa.array([r[1] for r in read], pa.string())))
        _need((to <= end[left]).all())
        which = np.concatenate([w for w, _ in found])
        rows.append(left[which])
        tags.append(held[here[which][:, None] + np.arange(2)])
        texts.append(pa.concat_arrays([t for _, t in found]))
        at[left] = to
        left = left[to < end[left]]
    if not rows:
        return pa.MapArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    row, tag = np.concatenate(rows), np.concatenate(tags)
    code = np.sort(row << 16 | tag[:, 0].astype(np.int64) << 8 | tag[:, 1])
    _need((np.diff(code) > 0).all())  # none is repeated
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), _strings(tag[order].ravel(), np.full(len(order), 2)), pa.concat_arrays(texts).take(pa.array(order)))
