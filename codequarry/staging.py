"""Tables written to the folder that driver and executors share, and rows in order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address below ``spark.checkpoint.dir``. Only a local session without such a folder gets one on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-codequarry-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/codequarry-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read again: computed once, its plan cut."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``n``, the place of each row in the order, from 1: sorted by ranges, each partition counted on from those before."""
    rows = stored(df.orderBy(*order).withColumn("n", F.monotonically_increasing_id()))
    part, place = F.shiftright("n", 33), F.col("n").bitwiseAND((1 << 33) - 1)
    counts = sorted((r.p, r.c) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())  # a row a partition
    before, starts = 0, []
    for p, c in counts:
        starts.append((p, before))
        before += c
    offsets = df.sparkSession.createDataFrame(starts, "p bigint, before bigint")
    return rows.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("n", F.col("before") + place + 1).drop("p", "before")


def carried(df: DataFrame, column: str, block: int = 4096) -> DataFrame:
    """``df`` (n: places from 1, as ``numbered`` gives them) with ``column`` filled by its last value at or before each row.

    Filled within blocks of rows; what a block begins with comes from one row a block.
    """
    from pyspark.sql import Window

    rows = df.withColumn("_b", F.floor((F.col("n") - 1) / block))
    ends = rows.where(F.col(column).isNotNull()).groupBy("_b").agg(F.max_by(column, "n").alias("_v"))
    all_ = rows.select("_b").distinct().join(ends, "_b", "left")
    before = all_.select("_b", F.last("_v", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_v"))
    here = F.last(column, ignorenulls=True).over(Window.partitionBy("_b").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(column, here).join(before, "_b").withColumn(column, F.coalesce(column, "_v")).drop("_b", "_v")


def in_order(df: DataFrame, key: str, order: list[str], start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """Ordered state by key, in bounded memory: rows come sorted, a batch at a time.

    ``start(key)`` makes a state, ``step(state, rows)`` takes its next rows (pandas)
    and ``end(state)`` closes it; the latter two give finished rows (or None). The
    work on one key is sequential.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in batches:
            for k, rows in pdf.groupby(key, sort=False, dropna=False):
                if state is None or not (k == now or (pd.isna(k) and pd.isna(now))):
                    if state is not None and (last := end(state)) is not None:
                        yield last
                    now, state = k, start(k)
                if (out := step(state, rows)) is not None:
                    yield out
        if state is not None and (last := end(state)) is not None:
            yield last

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
