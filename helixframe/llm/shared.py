"""Helpers of the training-data operators: reading, shared checkpoints, Arrow batches and sorted runs."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch that Python is given.
BATCH_BYTES = 4 << 20
#: Rows of hashes that are broadcast at most, some 100 MB; more go by a shuffle.
BROADCAST = 1_000_000
#: Rows of a key from which a join may deal it apart from the others.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local master takes a folder of its machine; a cluster can't."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="helixframe-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session has written, by Hadoop's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder; lost executors don't lose what was written.

    The shuffles behind it aren't needed any more. Spark deletes those that the driver's collector has found unused, which
    in a job of many steps comes late, so the collector is asked.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession._jvm.System.gc()
    return out


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of about ``BATCH_BYTES`` at most, a longer row being a batch of its own.

    Spark's own limit counts rows, so that a batch grows with the texts; the session keeps the limit set here. A worker
    gives back Arrow's free memory after each task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(task, schema)


def utf8(column: Column) -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    """The column of exactly that name, dots included."""
    return F.col(quoted_name(name))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as the columns of ``df`` call for."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, where a number has to be named."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_spread(rows: DataFrame, stats: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined to ``stats``, which has one row for a key and in ``count`` how many rows that key has.

    Of keys with over ``HOT`` rows the most frequent are broadcast, one for each shuffle partition at most, so that their rows
    stay where they are; any other key has at most a partition's share of all rows. ``rows`` is read twice.
    """
    hot = stats.where(F.col(count) > HOT).orderBy(F.desc(count), *keys).limit(parts(rows))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(stats, keys))


def few(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows, which decides if it may be broadcast; no more than that are counted."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def rows(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches, cut to ``most`` rows, which bounds what a Python worker holds as objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of two or more rows with equal integer keys from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def joined() -> pa.Table | None:
        t = pa.Table.from_batches(held)
        return t.combine_chunks() if t.num_rows > 1 else None

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n - 1, bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            if a == 0 and last == tuple(c[0] for c in columns):
                held.append(batch.slice(a, b - a))
                continue
            if held and (t := joined()) is not None:
                yield t
            held = [batch.slice(a, b - a)]
        last = tuple(c[-1] for c in columns)
    if held and (t := joined()) is not None:
        yield t
