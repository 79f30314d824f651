"""Live status and the combined log, kept by streams whose batches may be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codequarry.sources.files import json_lines, write_report
from codequarry.streaming.logs import log_stream

#: What one status belongs to.
KEY = ["run_id", "source_file", "chunk_index"]


def apply_updates(rows: DataFrame, batch: int, at: str) -> None:
    """The last status of each key in one batch of updates (KEY, status, ts) written under the batch's number.

    A batch that comes again overwrites what it wrote, so it changes nothing. Of equal
    times the greatest status by name counts.
    """
    last = rows.groupBy(*KEY).agg(F.max(F.struct("ts", "status")).alias("u")).select(*KEY, "u.status", "u.ts")
    last.write.mode("overwrite").parquet(f"{at.rstrip('/')}/batch={batch}")


def current_status(spark: SparkSession, at: str) -> DataFrame:
    """(KEY, status, ts): the latest update of each key over all batches written whole; of equal times that of the later batch."""
    rows = spark.read.parquet(at)
    return rows.groupBy(*KEY).agg(F.max(F.struct("ts", "batch", "status")).alias("u")).select(*KEY, "u.status", "u.ts")


def status_counts(status: DataFrame) -> DataFrame:
    """(run_id, pending, processing, completed, failed)"""
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return status.groupBy("run_id").agg(*[of(s) for s in ("Pending", "Processing", "Completed", "Failed")])


def compacted(spark: SparkSession, at: str, to: str) -> None:
    """The current status as the one batch 0 of a new store, for readers to change over to."""
    current_status(spark, at).write.mode("overwrite").parquet(f"{to.rstrip('/')}/batch=0")


def keep_status(updates: DataFrame, at: str, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """A started query that writes each batch of a stream of updates (KEY, status, ts) to the store at ``at``, in effect once.

    A batch that was written but not committed before a failure has the same number and
    the same rows when it comes again.
    """
    return updates.writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: apply_updates(rows, batch, at)).start()


def combined_log(spark: SparkSession, at: str) -> DataFrame:
    """All JSON entries of the *.log files below ``at`` as lines in order of time: ``timestamp [category] message``."""
    rows = json_lines(spark, f"{at.rstrip('/')}/*.log")
    line = F.concat_ws(" ", "timestamp", F.concat(F.lit("["), F.coalesce("category", F.lit("")), F.lit("]")), "message")
    return rows.orderBy("timestamp", "category", "message").select(line.alias("value"))


def rebuild_log(spark: SparkSession, at: str, to: str, version: int) -> None:
    """The combined log written anew as one version: part files in order, with their index."""
    write_report(combined_log(spark, at), f"{to.rstrip('/')}/version={version}", "text")


def keep_log(spark: SparkSession, at: str, to: str, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """A started query that rebuilds the combined log whenever new *.log files have come, once an ``interval`` at most."""
    return log_stream(spark, at).writeStream.trigger(processingTime=interval).option("checkpointLocation", checkpoint).foreachBatch(lambda _, batch: rebuild_log(spark, at, to, batch)).start()
