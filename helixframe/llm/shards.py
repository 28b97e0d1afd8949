"""Sharding by jump consistent hashing: no ring table, and an added shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shared import parts


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: jump forward by the generator until past the end."""
    key, at, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    todo = np.arange(len(keys))
    while len(todo := todo[ahead[todo] < shards]):
        at[todo] = ahead[todo]
        key[todo] = key[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        ahead[todo] = ((at[todo] + 1) * (2.0**31 / ((key[todo] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
    return at


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a long key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return run(key)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, CRC-32 of the text, shard, slot, and the shard that it has with one shard more.

    The shard depends on the id and the number of shards alone. Slots number a shard's rows from 0 without gaps in ascending
    id: ids are cut at quantiles into as many ranges as there are shuffle partitions, the rows of a shard and range are
    numbered on their own, and offsets come from the counts. Null texts count as empty; a null id has the key 0 and
    comes first; repeated rows get slots of their own, those with equal ids by CRC-32 and size; an empty table gives an empty result.
    """
    n, key = parts(docs), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint"))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))
    placed = sized.select("*", jump_shard(F.col("key"), shards).alias("shard"), jump_shard(F.col("key"), shards + 1).alias("grown_shard"), F.size(F.filter(bounds, lambda b: b <= F.col("key"))).alias("piece"))
    # One row for each shard and range: bounded by their numbers.
    counts = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "piece", (F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "piece").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = placed.withColumn("nth", F.row_number().over(order))
    return numbered.join(offsets, ["shard", "piece"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("bigint").alias("slot"), "grown_shard")
