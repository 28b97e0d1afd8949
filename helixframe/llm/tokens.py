"""Byte-level BPE ids of whole texts, equal to those of the tokenizer file, for packing.

The file's own library is slow, so texts go to a faster one with the same ranks and pre-token rule. Those on which the two
could differ, or on which the faster one fails, go to the file's own: texts with a special token's string, with letters
of blocks that newer Unicode versions add to, or with very long runs of white space.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

_ODD = re.compile(r"[^\x00-ɏ‐-‧€]|\s{1000}")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else the next free code above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FastTokenizer:
    """``ids(text)``: little-endian unsigned 32-bit ids, as the file's tokenizer gives without special tokens added."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        parts = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        order = [ranks[bytes(letters[c] for c in a + b)] for a, b in parts]
        if any(x >= y for x, y in zip(order, order[1:])):
            raise ValueError("ids don't follow the order of the merges")
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def fast_tokenizer(path: str) -> FastTokenizer:
    """One for a worker process, whose tasks share it."""
    return FastTokenizer(path)
