"""Incremental counters on Structured Streaming: the batch expressions over ``readStream`` tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from helixframe.functions import sequence as S


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per type and window; rows later than the watermark are dropped, and so is the state of closed windows."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def read_quality(reads: DataFrame) -> DataFrame:
    """Running totals over ``seq, qual``: state is one row."""
    return reads.agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"), F.count_if(S.mean_quality(F.col("qual")) >= 20).alias("good"))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; a key is remembered for as long as the watermark allows a late copy of it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, key: str, value: str, idle: str = "1 hour") -> DataFrame:
    """``key, n, total, greatest`` after each batch that has rows of the key, over all rows of it so far.

    The state of a key is three numbers, kept in event time: it goes when the watermark is ``idle`` past the key's last event.
    """
    hold = int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def update(which: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, greatest, last = state.get if state.exists else (0, 0.0, -math.inf, 0)
        if last + hold < state.getCurrentWatermarkMs():  # timed out, but its new rows came first
            n, total, greatest = 0, 0.0, -math.inf
        for part in parts:
            n, total, greatest = n + len(part), total + float(part[value].sum()), max(greatest, float(part[value].max()))
            last = max(last, int(part["ts"].max().timestamp() * 1000))
        state.update((n, total, greatest, last))
        state.setTimeoutTimestamp(max(last + hold, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [which[0]], "n": [n], "total": [total], "greatest": [greatest]})

    kept = events.select("ts", F.col(key).cast("bigint").alias("key"), F.col(value).cast("double").alias(value)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    return kept.groupBy("key").applyInPandasWithState(update, "key bigint, n bigint, total double, greatest double", "n bigint, total double, greatest double, last bigint", "append", "EventTimeTimeout")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What the stream gives for all that is there now, by way of Parquet files under ``path``."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
