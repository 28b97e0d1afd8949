"""Range asymmetric numeral systems as in CRAM: the coder with byte renormalisation (3.0) and that with 16-bit words (3.1)."""

from __future__ import annotations

import struct
from collections.abc import Callable

# Fixed values of the 16-bit coder's format: the bits of its first byte.
ORDER, WIDE, STRIPE, NO_SIZE, PLAIN, RUNS, PACK = 1, 4, 8, 16, 32, 64, 128


class Bytes:
    """Reads numbers one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("a block is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def word(self, form: str) -> int:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def seven(self) -> int:
        """Seven bits a byte, the highest first."""
        out = 0
        while True:
            b = self.byte()
            out = out << 7 | b & 127
            if b < 128:
                return out


def _symbols(source: Bytes, each: Callable[[int], None]) -> None:
    """Calls ``each`` with ascending symbols; a symbol that follows the one before it brings the number of more that do."""
    symbol, run = source.byte(), 0
    while True:
        each(symbol)
        if run:
            run, after = run - 1, symbol + 1
        else:
            after = source.byte()
            if after == symbol + 1:
                run = source.byte()
        if after == 0:
            return
        symbol = after


def _slots(counts: dict[int, int], bits: int) -> tuple[list[int], list[int], list[int]]:
    """Of each slot its symbol, the symbol's number of slots, and the slot's place among these."""
    symbols, widths, places = [], [], []
    for symbol, n in sorted(counts.items()):
        symbols += [symbol] * n
        widths += [n] * n
        places += range(n)
    rest = (1 << bits) - len(symbols)
    if rest < 0:
        raise ValueError("frequencies exceed their sum")
    return symbols + [0] * rest, widths + [0] * rest, places + [0] * rest


def _decode(source: Bytes, n: int, ways: int, bits: int, tables: dict[int, tuple] | tuple, low: int, step: int) -> bytes:
    """``n`` symbols out of ``ways`` states. With tables by the symbol before, each state has a run of its own and the last the rest."""
    states = [source.word("I") for _ in range(ways)]
    data, at, mask, out = source.data, source.at, (1 << bits) - 1, bytearray(n)
    ordered = isinstance(tables, dict)
    part = n // ways
    before = [0] * ways
    for i in range(n):
        if ordered:
            way, place = (i % ways, i // ways + i % ways * part) if i < part * ways else (ways - 1, i)
            symbols, widths, places = tables[before[way]]
        else:
            way, place = i % ways, i
            symbols, widths, places = tables
        state = states[way]
        slot = state & mask
        out[place] = before[way] = symbols[slot]
        state = widths[slot] * (state >> bits) + places[slot]
        while state < low and at + step <= len(data):
            state = state << 8 | data[at] if step == 1 else state << 16 | data[at] | data[at + 1] << 8
            at += step
        states[way] = state
    source.at = at
    return bytes(out)


def decode_4x8(data: bytes) -> bytes:
    source = Bytes(data)
    order, _, n = source.byte(), source.word("I"), source.word("I")
    if not n:
        return b""

    def counts() -> dict[int, int]:
        found: dict[int, int] = {}

        def one(symbol: int) -> None:
            first = source.byte()
            found[symbol] = ((first & 127) << 8 | source.byte() if first > 127 else first) or 4096

        _symbols(source, one)
        return found

    if not order:
        return _decode(source, n, 4, 12, _slots(counts(), 12), 1 << 23, 1)
    tables: dict[int, tuple] = {}
    _symbols(source, lambda symbol: tables.__setitem__(symbol, _slots(counts(), 12)))
    return _decode(source, n, 4, 12, tables, 1 << 23, 1)


def _scaled(counts: dict[int, int], bits: int) -> dict[int, int]:
    total = sum(counts.values())
    shift = 0
    while total and total << shift < 1 << bits:
        shift += 1
    return {s: c << shift for s, c in counts.items()}


def _alphabet(source: Bytes) -> list[int]:
    found: list[int] = []
    _symbols(source, found.append)
    return found


def _order0(source: Bytes, n: int, ways: int) -> bytes:
    counts = {s: 0 for s in _alphabet(source)}
    counts = {s: source.seven() for s in counts}
    return _decode(source, n, ways, 12, _slots(_scaled(counts, 12), 12), 1 << 15, 2)


def _order1(source: Bytes, n: int, ways: int) -> bytes:
    head = source.byte()
    bits, table = head >> 4, source
    if head & 1:
        size, packed = source.seven(), source.seven()
        table = Bytes(_order0(Bytes(source.take(packed)), size, 4))
    alphabet, tables = _alphabet(table), {}
    for context in alphabet:
        counts, run = {}, 0
        for symbol in alphabet:
            if run:
                run -= 1
                continue
            counts[symbol] = table.seven()
            if not counts[symbol]:
                run = table.byte()
        tables[context] = _slots(_scaled(counts, bits), bits)
    return _decode(source, n, ways, bits, tables, 1 << 15, 2)


def decode_16(data: bytes, size: int | None = None) -> bytes:
    """The coder with 16-bit words; ``size`` is the length where the stream doesn't name it."""
    source = Bytes(data)
    flags = source.byte()
    if not flags & NO_SIZE:
        size = source.seven()
    ways = 32 if flags & WIDE else 4
    if flags & STRIPE:
        sizes = [source.seven() for _ in range(source.byte())]
        out = bytearray(size)
        for i, packed in enumerate(sizes):
            out[i :: len(sizes)] = decode_16(source.take(packed), len(range(i, size, len(sizes))))
        return bytes(out)
    n, letters, runs = size, b"", None
    if flags & PACK:
        letters = source.take(source.byte())
        n = source.seven()
    if flags & RUNS:
        head, unrolled = source.seven(), n
        n = source.seven()
        runs = Bytes(source.take(head >> 1) if head & 1 else _order0(Bytes(source.take(source.seven())), head >> 1, ways))
    if flags & PLAIN:
        out = source.take(n)
    else:
        out = (_order1 if flags & ORDER else _order0)(source, n, ways) if n else b""
    if runs:
        repeated = set(runs.take(runs.byte() or 256))
        out = b"".join(bytes([s]) * (1 + runs.seven()) if s in repeated else bytes([s]) for s in out)
        if len(out) != unrolled:
            raise ValueError("runs don't add up")
    if flags & PACK:
        bits = next((b for most, b in ((1, 0), (2, 1), (4, 2), (16, 4)) if len(letters) <= most), None)
        if bits is None:
            raise ValueError("too many packed symbols")
        if not bits:
            out = letters[:1] * size
        else:
            out = bytes(letters[b >> at & (1 << bits) - 1] for b in out for at in range(0, 8, bits))[:size]
    if len(out) != size:
        raise ValueError("a block is cut off")
    return out
