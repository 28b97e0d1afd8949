"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import map_batches, rows


class Remembered:
    """A bounded two-generation cache around ``make``: when the young one is full, the old one goes."""

    def __init__(self, make: Callable[[str], bytes], most: int = 250_000, longest: int = 64):
        self.make, self.most, self.longest, self.young, self.old = make, most, longest, {}, {}

    def __call__(self, key: str) -> bytes:
        if (found := self.young.get(key)) is not None:
            return found
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for word, rank in self.ranks.items():
            self.bytes_of[rank] = word
        self.low = [0] * ((len(self.bytes_of) >> 10) + 1)
        self.buckets: list[list[int]] = [[] for _ in self.bytes_of]
        self.bit = [1 << i for i in range(1024)]
        self.split = regex.compile(pattern).findall
        self.piece = Remembered(lambda s: pack(f"<{len(ids := self.merge(s.encode()))}I", *ids), 600_000)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length: the smallest rank first, the leftmost of equal ones.

        Positions are the nodes of a linked list over the bytes. Each rank has a bucket of positions, a heap; a two-level
        bitmap of the ranks with a bucket, 1024 to a word, finds the next rank by its lowest set bits. An entry is stale if
        its node has gone or its pair has another rank by now. The queue ends empty, so that it is kept for the next piece.
        """
        rank_of, low, buckets, bit_of, top = self.ranks.get, self.low, self.buckets, self.bit, 0
        if (known := rank_of(piece)) is not None:
            return [known]
        n = len(piece)
        end, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        for i in range(n - 1):
            if (r := rank_of(piece[i : i + 2])) is not None:
                pair[i] = r
                if not (bucket := buckets[r]):
                    low[r >> 10] |= bit_of[r & 1023]
                    top |= bit_of[r >> 10]
                bucket.append(i)  # ascending, and so a heap
        while top:
            high = top & -top
            w = high.bit_length() - 1
            word = low[w]
            bit = word & -word
            r = w << 10 | bit.bit_length() - 1
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                low[w] = word = word ^ bit
                if not word:
                    top ^= high
            if pair[i] != r:
                continue
            j = end[i]
            e = end[i] = end[j]
            pair[i] = pair[j] = -1
            if e < n:
                before[e] = i
                if (r := rank_of(piece[i : end[e]])) is not None:
                    pair[i] = r
                    if not (bucket := buckets[r]):
                        low[r >> 10] |= bit_of[r & 1023]
                        top |= bit_of[r >> 10]
                    heappush(bucket, i)
            if (k := before[i]) >= 0:
                pair[k] = -1
                if (r := rank_of(piece[k:e])) is not None:
                    pair[k] = r
                    if not (bucket := buckets[r]):
                        low[r >> 10] |= bit_of[r & 1023]
                        top |= bit_of[r >> 10]
                    heappush(bucket, k)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        get, out = self.piece, []
        young = get.young
        for s in self.split(text):
            if (found := young.get(s)) is None:
                found = get(s)
                young = get.young
            out.append(found)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One for a worker process, whose tasks share its table and remembered pieces."""
    return BytePairs(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row: the whole text's ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. ``ranks`` is a path that every executor has. No shuffle; repeated rows each keep a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(ranks, pattern)
        for batch in rows(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.encode(x.as_py() or "") for x in batch.column(1)], pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids, decoded`` (bytes) of ``doc_id, ids``; null ids decode to none; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(ranks, pattern)
        for batch in rows(batches, 500):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bpe.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def token_digests(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: count and digest of each text's ids, and the digest of the bytes that they decode to.

    Null and empty texts have no ids; repeated rows each keep a row; an empty table gives an empty result; other columns
    are ignored. Texts are encoded and decoded in one pass, so that ids don't move.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(ranks, pattern)
        for batch in rows(batches, 500):
            ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
            marks = ([len(x) // 4 for x in ids], [sha256(x).hexdigest() for x in ids], [sha256(bpe.decode(x)).hexdigest() for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks[0], pa.int64()), pa.array(marks[1], pa.string()), pa.array(marks[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
