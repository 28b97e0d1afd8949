"""Word shingles and the majority bits of their hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np

#: Bits of a byte, the highest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_CHUNK = 1 << 16


def shingles(words: list[bytes], size: int) -> Iterator[bytes]:
    """All runs of ``size`` words, repeats included; fewer words give the whole sequence, none nothing."""
    if not words:
        return iter(())
    joined = b" ".join(words)
    if len(words) <= size:
        return iter((joined,))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return (joined[a:b] for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()))


def majority(hashes: Iterator[bytes], width: int) -> bytes:
    """Bits set in over half of the hashes of ``width`` bytes; no hash gives zero bits."""
    counts, n = np.zeros((width, 8), np.int64), 0
    offsets = np.arange(width, dtype=np.int64) * 256
    while part := b"".join(islice(hashes, _CHUNK)):
        seen = np.frombuffer(part, np.uint8).reshape(-1, width) + offsets
        counts += np.bincount(seen.ravel(), minlength=256 * width).reshape(width, 256) @ _BITS
        n += len(seen)
    return np.packbits(counts.ravel() * 2 > n).tobytes()
