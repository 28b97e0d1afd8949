"""Cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shared import map_batches, rows
from helixframe.llm.tokens import fast_tokenizer

#: Tokens of a sequence, and the attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LENGTH, LINEAR, QUADRATIC = 2048, 1.0, 1.0 / 1024
#: Tokens gathered in a task before a group of sequences is filled: bounds memory, and padding to below one sequence each.
GROUP = 4_000_000
#: The id that closes a document.
END = 1


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """``document, start, size, sequence, offset`` of every piece.

    As many sequences as the tokens need at least. Documents over one sequence are cut to full ones first. The rest go, the
    longest first, to the sequence of the lowest cost that has room; what has room nowhere is cut to fill the cheapest
    sequences with any room. Ties go to the smaller number.
    """
    m = -(-sum(lengths) // length)
    room, fill = [length] * m, [0.0] * m
    # How often a sequence has moved: an entry of a heap with an older number is stale.
    moved = [0] * m
    # By cost, those that may have room; and those that the last item didn't fit, by room and by cost.
    cheap = [(0.0, s, 0) for s in range(m)]
    by_room: list[tuple[int, int, int]] = []
    by_cost: list[tuple[float, int, int]] = []
    pieces, items = [], []
    for d, n in enumerate(lengths):
        whole = n - n % length
        items += [(length, d, at) for at in range(0, whole, length)]
        if n > whole:
            items.append((n - whole, d, whole))

    def offer(s: int) -> None:
        moved[s] += 1
        heapq.heappush(cheap, (fill[s], s, moved[s]))

    def put(d: int, at: int, n: int, s: int) -> None:
        pieces.append((d, at, n, s, length - room[s]))
        room[s] -= n
        fill[s] += cost(n)
        if room[s]:
            offer(s)

    # Items get shorter, so what had no room may have some again; each sequence moves once for a piece that it is given.
    for n, d, at in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        while by_room and -by_room[0][0] >= n:
            _, s, t = heapq.heappop(by_room)
            if moved[s] == t:
                offer(s)
        while cheap and room[cheap[0][1]] < n:
            c, s, t = heapq.heappop(cheap)
            heapq.heappush(by_room, (-room[s], s, t))
            heapq.heappush(by_cost, (c, s, t))
        if cheap:
            put(d, at, n, heapq.heappop(cheap)[1])
            continue
        while n:
            _, s, t = heapq.heappop(by_cost)
            if moved[s] == t:
                part = min(room[s], n)
                moved[s] += 1
                put(d, at, part, s)
                at, n = at + part, n - part
    return pieces


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` for every piece of every document.

    A document is the ids of its whole text and a closing id 1; null texts are empty, so every row has a piece. Each task
    tokenizes and packs its own rows in groups of about ``group`` tokens, without a shuffle; only a group's last few tokens
    of room stay empty. A sequence's number holds its task's partition, so lost tasks are repeated with the same result.
    Repeated rows and null ids are packed like any other; an empty table gives an empty result.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, end = fast_tokenizer(tokenizer), np.array([END], "<u4").tobytes()
        base, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            nonlocal base
            pieces = assign([len(x) // 4 for _, x in held], length)
            for at in range(0, len(pieces), 500):
                out = []
                for d, start, n, s, offset in pieces[at : at + 500]:
                    ids = held[d][1][4 * start : 4 * (start + n)]
                    out.append((held[d][0], start, n, zlib.crc32(ids), len(held[d][1]) // 4, base + s, offset, ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
            base += -(-tokens // length)

        for batch in rows(batches, 200):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = fast.ids(text.as_py() or "") + end
                held.append((i, ids))
                tokens += len(ids) // 4
                if tokens >= group:
                    yield from full()
                    held, tokens = [], 0
        if held:
            yield from full()

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, schema)
