"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.shared import free_name, map_batches, rows

#: Lengths of the n-grams, and buckets that they are hashed to.
SIZES, BUCKETS = (3, 4, 5), 1 << 17
#: Labelled texts that the classifier is fitted on at most, of label 0 and 1; those with the smallest hashes of the id.
SAMPLE = (1800, 1000)
#: Code points of the sample at most; the first texts beyond it are left out.
CHARS = 12_000_000
#: Weight of a toxic text's error against a clean one's, both labels being made equally frequent first.
TOXIC_SHARE = 0.45
_BASE = 0x9E3779B97F4A7C15


def grams(text: str) -> list[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text, by length."""
    p = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    out, h = [], p
    for n in range(2, max(SIZES) + 1):
        if len(p) < n:
            break
        h = h[:-1] * np.uint64(_BASE) + p[n - 1 :]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(47)).astype(np.int64))
    return out


def features(text: str) -> np.ndarray:
    """Buckets that occur in the text, each once."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *grams(text)]))


def blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of texts with about ``most`` features each: their place, their numbers of features, and the features."""
    first, found, size = 0, [], 0
    for i, text in enumerate(texts):
        found.append(features(text).astype(np.int32))
        size += len(found[-1])
        if size >= most or i == len(texts) - 1:
            yield slice(first, i + 1), np.array([len(f) for f in found]), np.concatenate(found)
            first, found, size = i + 1, [], 0


def fit(texts: list[str], labels: np.ndarray, rounds: int = 50, l2: float = 1e-3) -> np.ndarray:
    """Weights by bucket, and the offset last: full-batch gradient descent with momentum on scaled, length-normed features.

    Held are four bytes a feature; each step goes block by block.
    """
    y, held = np.asarray(labels, np.float64), list(blocks(texts))

    def by_bucket(each: np.ndarray) -> np.ndarray:
        """Sum over the texts that hold each bucket."""
        return sum((np.bincount(index, np.repeat(each[at], sizes), BUCKETS) for at, sizes, index in held), np.zeros(BUCKETS))

    def by_text(each: np.ndarray) -> np.ndarray:
        """Sum over the buckets that each text holds."""
        sums = [np.bincount(np.repeat(np.arange(len(sizes)), sizes), each[index], len(sizes)) for _, sizes, index in held]
        return np.concatenate([np.zeros(0), *sums])

    toxic, clean = by_bucket(y) + 1, by_bucket(1 - y) + 1
    scale = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    norm = 1 / np.sqrt(np.maximum(1, np.concatenate([np.zeros(0), *[sizes for _, sizes, _ in held]])))
    share = np.where(y == 1, TOXIC_SHARE / max(1, y.sum()), (1 - TOXIC_SHARE) / max(1, (1 - y).sum()))
    weight, offset = np.zeros(BUCKETS), 0.0
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, rounds + 1):
        z = by_text(weight * scale) * norm + offset
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        slope = np.append(by_bucket(miss * norm) * scale + l2 * weight / BUCKETS, miss.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        weight, offset = weight - step[:-1], offset - step[-1]
    return np.append(weight * scale, offset).astype(np.float32)


class Scorer:
    """Probability of label 1; also for a text without n-grams, which gets the offset alone."""

    def __init__(self, model: np.ndarray):
        self.weight, self.offset, self.mark = model[:-1], float(model[-1]), np.zeros(BUCKETS, np.float32)

    def __call__(self, text: str) -> float:
        found = grams(text)
        for f in found:
            self.mark[f] = 1
        z = float(self.weight @ self.mark) / max(1.0, float(self.mark.sum())) ** 0.5 + self.offset
        for f in found:
            self.mark[f] = 0
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(labelled: DataFrame) -> np.ndarray:
    """The model of a bounded sample, fitted in one task; without both labels the model scores every text 0."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "text", "label"], kind="stable")
        return pd.DataFrame({"model": [fit(frame["text"].tolist(), frame["label"].to_numpy()).tobytes()]})

    found = labelled.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "model binary").first()
    model = np.frombuffer(bytes(found.model), np.float32) if found else np.append(np.zeros(BUCKETS, np.float32), np.float32(-30))
    return model


def score_texts(docs: DataFrame, model: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` plus, last, the score of the whole text (null: as the empty one); no shuffle.

    If ``docs`` has a column of the score's name already, underscores are put after it. Repeated rows each keep a row; an
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 floats at any size
    name, at = free_name(docs, score_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(held.value)
        for batch in rows(batches):
            got = pa.array([score(x.as_py() or "") for x in batch.column(0).field(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], ["row", "score"])

    # One struct, for a batch's columns can't have just any names.
    made = map_batches(docs.select(F.struct("*").alias("row")), run, T.StructType([T.StructField("row", docs.schema), T.StructField("score", T.DoubleType())]))
    return made.select("row.*", F.col("score").alias(name))


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of 5; never trained on. A null id is read as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_texts(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, label`` of the sample to learn from: labelled and not held out; null ids and labels are left out.

    At most ``most[label]`` texts of each label and ``CHARS`` code points in all, those with the smallest hashes of the id;
    of rows with one id and text one is taken. The sample is drawn from lengths and hashes, so that only its own texts move,
    and its size bounds the broadcast.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    text = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = marks.distinct().join(text.select("id", "h", F.length("text").alias("n")), "id").distinct()
    each = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id", "h").limit(most[v]) for v in (0, 1)]
    # At most sum(most) rows, so that one task may add up their lengths.
    order = Window.orderBy(F.xxhash64("id"), "id", "h", "label")
    chosen = each[0].union(each[1]).withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= CHARS).select("id", "h", "label")
    return text.join(F.broadcast(chosen), ["id", "h"]).groupBy("id", "h", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from a bounded sample of rows that aren't held out (``SAMPLE``). Ids, languages, sources and labels
    are never inputs of a score, so equal texts have equal scores. Null texts score as empty ones; repeated rows each keep a row;
    without labels of both kinds every score is 0 (about 1e-13); an empty table gives an empty result; extra columns are ignored.
    """
    model = train(labelled_texts(docs, labels, SAMPLE, id_col, text_col))
    scored = score_texts(docs.select(id_col, text_col), model, text_col, "score")
    return scored.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
