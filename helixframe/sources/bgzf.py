"""Blocked gzip: blocks of at most 64 KB that can be entered at a virtual offset (block's offset << 16 | offset inside)."""

from __future__ import annotations

import struct
import zlib

#: Uncompressed bytes of a block that is written.
BLOCK = 60_000


def deflate_block(data: bytes, level: int = 6) -> bytes:
    """One block of at most ``BLOCK`` bytes; of none: the mark at a file's end."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def block_size(data: memoryview, at: int) -> int:
    """Compressed size of the block at ``at``, from its BC field."""
    if len(data) - at < 18 or data[at : at + 4] != b"\x1f\x8b\x08\x04":
        raise ValueError(f"no blocked gzip at byte {at}")
    field, end = at + 12, at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    while field + 4 <= end:
        kind, size = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + size
    raise ValueError(f"the gzip member at byte {at} has no block size")


class BlockReader:
    """Reads the uncompressed bytes block by block; one block is held."""

    def __init__(self, data: bytes):
        self.data, self.at, self.next, self.held, self.used = memoryview(data), 0, 0, b"", 0

    def _advance(self) -> bool:
        if self.next >= len(self.data):
            return False
        size = block_size(self.data, self.next)
        if self.next + size > len(self.data):
            raise ValueError(f"the block at byte {self.next} is cut off")
        self.held, self.used = zlib.decompress(self.data[self.next : self.next + size], 31), 0
        self.at, self.next = self.next, self.next + size
        return True

    def seek(self, offset: int) -> None:
        self.at = self.next = offset >> 16
        self.held = b""
        if self._advance():
            self.used = offset & 0xFFFF

    def tell(self) -> int:
        """Virtual offset of the next byte."""
        return self.next << 16 if self.used >= len(self.held) else self.at << 16 | self.used

    def read(self, n: int = -1) -> bytes:
        """``n`` bytes, fewer at the end, or all that are left."""
        parts, left = [], n
        while left:
            if self.used >= len(self.held):
                if not self._advance():
                    break
                continue
            part = self.held[self.used :] if left < 0 else self.held[self.used : self.used + left]
            self.used += len(part)
            left -= len(part) if left > 0 else 0
            parts.append(part)
        return b"".join(parts)
