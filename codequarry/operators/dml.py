"""Writes as pure functions (base, change) -> new base, and a run-partitioned store of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_run(base: DataFrame, new: DataFrame, run_id: int) -> DataFrame:
    """All rows of a run replaced by ``new``."""
    return base.where(F.col("run_id") != run_id).unionByName(new)


def without_run(tables: dict[str, DataFrame], run_id: int) -> DataFrame:
    """(t, id) of the rows that stay in each table when a run's context goes."""
    parts = [df.where(F.col("run_id") != run_id).select(F.lit(name).alias("t"), F.col("id").cast("bigint").alias("id")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def commit_run(spark, tables: dict[str, DataFrame], run_id: int, at: str) -> None:
    """All of a run's rows in several tables replaced together.

    Each table's rows are written under a name of this attempt; then one pointer
    names the attempt, and readers only follow pointers. The pointer replaces an
    older one in a single rename.
    """
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}/run={run_id}/{attempt}")
    sc = spark.sparkContext
    path = lambda p: sc._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(at).getFileSystem(sc._jsc.hadoopConfiguration())
    ready, final = path(f"{at}/_runs/.{attempt}"), path(f"{at}/_runs/{run_id}")
    out = fs.create(ready, False)
    out.write(bytearray(attempt.encode()))
    out.close()
    options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = sc._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), sc._jsc.hadoopConfiguration()).rename(ready, final, options)


def read_run(spark, at: str, name: str, run_id: int) -> DataFrame:
    """The rows of a committed run in one of its tables."""
    attempt = spark.read.text(f"{at}/_runs/{run_id}").first()[0]
    return spark.read.parquet(f"{at}/{name}/run={run_id}/{attempt}")


def write_run(new: DataFrame, at: str) -> None:
    """Overwrite only the partitions of the runs in ``new``, then mark each run committed; readers skip unmarked runs."""
    new.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{at}/data")
    new.select("run_id").distinct().withColumn("committed", F.lit(True)).write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{at}/committed")


def read_committed(spark, at: str) -> DataFrame:
    done = spark.read.parquet(f"{at}/committed").select("run_id").distinct()
    return spark.read.parquet(f"{at}/data").join(done, "run_id", "left_semi")


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], overwritten: list[str]) -> DataFrame:
    """Rows of ``updates`` inserted, or their ``overwritten`` columns put over the row of equal keys; other columns survive.

    Keys are unique on both sides.
    """
    new = updates.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias("_new"))
    old = base.withColumn("_old", F.lit(True))
    both = old.join(new, keys, "full_outer")
    return both.select(*[F.col(c) if c in keys else F.when(F.col("_old").isNull(), F.col(f"_new.{c}")).when(F.col("_new").isNotNull() & F.lit(c in overwritten), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def first_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert or ignore: the earliest row of each key."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), seq).alias("_r")).select(*keys, "_r.*")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Insert or replace: the latest row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), seq).alias("_r")).select(*keys, "_r.*")


def patch(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Only the fields that an update supplies (not null) change."""
    changed = [c for c in updates.columns if c not in keys]
    both = base.join(updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in changed]), keys, "left")
    return both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in base.columns])


def update_where(base: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set to ``values`` where ``condition`` holds; a null condition changes nothing."""
    return base.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def cancel_stale(runs: DataFrame, now, hours: int = 1) -> DataFrame:
    """Running runs that started over ``hours`` before ``now`` become Cancelled."""
    stale = (F.col("status") == "Running") & (F.col("started_at") < F.lit(now) - F.expr(f"interval {hours} hours"))
    return update_where(runs, stale, status=F.lit("Cancelled"))


def resolve(refs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Open references whose target has a signature become resolved by it; signatures: (run_id, method, signature), unique keys."""
    known = signatures.select("run_id", F.col("method").alias("target_method"), F.col("signature").alias("_s"))
    both = refs.join(known, ["run_id", "target_method"], "left")
    hit = ~F.col("resolved") & F.col("_s").isNotNull()
    return both.withColumn("actual_signature", F.when(hit, F.col("_s")).otherwise(F.col("actual_signature"))).withColumn("resolved", F.col("resolved") | hit).select(*refs.columns)


def with_parents(files: DataFrame, children: DataFrame) -> DataFrame:
    """A placeholder file for each child whose file is missing."""
    lost = children.select(F.col("cobol_file_id").alias("id")).distinct().join(files.select("id"), "id", "left_anti")
    return files.unionByName(lost.withColumn("file_name", F.concat(F.lit("missing_"), F.col("id").cast("string"))), allowMissingColumns=True)


def merged_graph(deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (run_id, file) and one edge for each (run_id, source, target) with its last type."""
    edges = deps.groupBy("run_id", "source_file", "target_file").agg(F.max_by("dependency_type", "id").alias("dependency_type"))
    nodes = deps.select("run_id", F.col("source_file").alias("file")).union(deps.select("run_id", "target_file")).distinct()
    return nodes, edges


def collapse_parallel_edges(deps: DataFrame) -> DataFrame:
    """(source_file, target_file, dependency_type, run_id, merged): one edge a pair over all runs, with the type and run of its last row by id, and how many rows it stands for."""
    return deps.groupBy("source_file", "target_file").agg(F.max_by("dependency_type", "id").alias("dependency_type"), F.max_by("run_id", "id").alias("run_id"), F.count("*").alias("merged"))


def normalised(df: DataFrame, text: str, number: str) -> DataFrame:
    """Blank text and numbers of 0 or less become null."""
    return df.withColumn(text, F.nullif(F.trim(text), F.lit(""))).withColumn(number, F.when(F.col(number) > 0, F.col(number)))
