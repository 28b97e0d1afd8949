"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its predecessor kept. All but the last return
the columns of ``documents``; ``run`` applies them in turn. SQL can't express them, so tests use brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import linededup, packing, simhash, toxicity
from helixframe.llm.shared import BROADCAST, checkpoint, few, quoted, quoted_name, remove, shared_folder, table

#: Near duplicates: fingerprints on five-word shingles and MinHash bands find the candidates, the exact Jaccard similarity
#: of the sets of shingles decides.
NEAR = {"size": 5, "distance": 3, "jaccard": 0.8}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives less than 0.5; it learns from the labelled ones that aren't held out.

    Null texts score as empty ones; without labels of both kinds all documents stay; repeated rows all stay or all go; an empty
    table gives an empty result; other columns may have any names.
    """
    model = toxicity.train(toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    scored = toxicity.score_texts(docs, model, "text", "score")
    return scored.where(F.col(scored.columns[-1]) < 0.5).select(*map(quoted, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of a line that 10 or more of them hold, only its first place stays.

    Texts that lose nothing stay as they are, null ones too; ``n_chars``, if there, is that of the kept text; repeated rows
    all lose the same; an empty table gives an empty result; other columns may have any names.
    """
    out = linededup.dedup_lines(docs, min_docs=10, min_chars=1, keep_first=True)
    dropped, kept = map(F.col, out.columns[-2:])
    new = {"text": kept, "n_chars": F.length(kept).cast("bigint")}
    return out.select(*[F.when(dropped > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else quoted(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates, by id and then by the text's hash.

    Rows with the same id but other texts are documents of their own. Of rows with the same id and text one stays, the
    least by its other columns. A null id is smaller than all others; null, empty and blank texts are one group; an empty
    table gives an empty result; other columns may have any names.
    """
    row, key = F.struct("*").alias("row"), F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = simhash.near_duplicates(docs.select(key.alias("doc_id"), "text"), **NEAR)
    # Documents that go, and those that stay once of several rows: most documents are neither, and needn't move.
    marks = checkpoint(found.groupBy("id").agg(F.count("*").alias("n"), F.min("component").alias("component")).where("id <> component or n > 1"))
    marked, again = marks.select(F.col("id").alias("key")), marks.where("id = component").select(F.col("id").alias("key"))
    if few(marks, BROADCAST):
        marked, again = F.broadcast(marked), F.broadcast(again)
    keyed = docs.select(row, key.alias("key"))
    rest = [F.col(f"row.{quoted_name(f.name)}") for f in docs.schema.fields if "map<" not in (kind := f.dataType.simpleString()) and "variant" not in kind]
    one = keyed.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(*rest)).alias("row"))
    return keyed.join(marked, "key", "left_anti").select("row").union(one.select("row")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 2048-token sequences, with their ids.

    Null texts are empty, so every row has a piece; repeated rows and null ids are packed like any other; an empty table gives an
    empty result; other columns are left out.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("packing", pack)]
#: Learned scores, fingerprints and token ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again, and goes when the next is there."""
    docs, folder, last = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
