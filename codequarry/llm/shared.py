"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder's address under ``spark.checkpoint.dir``.

    Only where the session names no such folder (tests, local runs) is one made
    on this machine; a cluster has to set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext.getCheckpointDir()
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not found:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-codequarry-"))
            found = spark.sparkContext.getCheckpointDir()
        root = found
    return f"{root.rstrip('/')}/codequarry-{uuid.uuid4().hex}"


def ready_checkpoints(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The plan of what follows starts at files that outlive any executor, and a
    table that is used several times is computed once.
    """
    spark = df.sparkSession
    at = shared_dir(spark)
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp): the columns of ``docs``, whatever their names, as one struct beside doc_id and a hash of the text.

    ``select("row.*")`` gives them back.
    """
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(own.alias("row"), "doc_id", F.xxhash64("text").alias("fp"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are not among ``gone`` (doc_id, fp), with their own columns."""
    gone = gone.select(F.col("doc_id").alias("d"), F.col("fp").alias("f")).distinct()
    rows = keyed(docs)
    return rows.join(gone, rows.doc_id.eqNullSafe(gone.d) & (rows.fp == gone.f), "left_anti").select("row.*")
