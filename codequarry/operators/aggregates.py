"""Conditional aggregates over runs, files, chunks, dependencies and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.graph import circular, plain_edges, strong_components


def total_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """100 * part / whole as a double; ``empty`` where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(empty))


def _is(*states: str) -> Column:
    return F.col("status").isin(*states)


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def chunk_status(chunks: DataFrame, *keys: str) -> DataFrame:
    """Chunks, completed, failed, pending, time, tokens and progress by ``keys``; without keys one row, even of nothing."""
    out = chunks.groupBy(*keys).agg(F.count("*").alias("total"), total_if(_is("Completed")).alias("completed"), total_if(_is("Failed")).alias("failed"), total_if(_is("Pending", "Processing")).alias("pending"), _sum("processing_time_ms").alias("time_ms"), _sum("tokens_used").alias("tokens"))
    return out.withColumn("progress", percent(F.col("completed"), F.col("total")))


def status_pivot(chunks: DataFrame) -> DataFrame:
    return chunks.agg(*[total_if(F.col("status") == s).alias(s.lower()) for s in ("Pending", "Processing", "Completed", "Failed")])


def file_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), total_if(~F.col("is_copybook")).alias("programs"), total_if(F.col("is_copybook")).alias("copybooks"))


def distinct_by_suffix(files: DataFrame) -> DataFrame:
    """Distinct names by suffix, without regard to case."""
    name = F.lower("file_name")
    return files.agg(F.countDistinct("file_name").alias("files"), F.countDistinct(F.when(name.endswith(".cbl"), F.col("file_name"))).alias("cbl"), F.countDistinct(F.when(name.endswith(".cpy"), F.col("file_name"))).alias("cpy"))


def type_counts(deps: DataFrame, types: list[str]) -> DataFrame:
    """One wide row: all dependencies, and those of each type."""
    return deps.agg(F.count("*").alias("total"), *[total_if(F.col("dependency_type") == t).alias(t.lower().replace(" ", "_")) for t in types])


def file_spans(chunks: DataFrame, *keys: str) -> DataFrame:
    """Chunks, first and last line, and lines covered by each key."""
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).withColumn("span", F.col("last_line") - F.col("first_line") + 1)


def resume_point(chunks: DataFrame, *keys: str) -> DataFrame:
    """The last completed chunk by key, -1 if none is."""
    return chunks.groupBy(*keys).agg(F.coalesce(F.max(F.when(_is("Completed"), F.col("chunk_index"))), F.lit(-1)).alias("last_completed"))


def dependency_metrics(deps: DataFrame, copies: DataFrame) -> DataFrame:
    """Programs, copybooks, dependencies, mean by program, the copybook of most uses (of equals the first by name), and the circular dependencies."""
    d = deps.agg(F.countDistinct("source_file").alias("programs"), F.count("*").alias("dependencies")).withColumn("average", F.coalesce(F.try_divide(F.col("dependencies").cast("double"), F.col("programs").cast("double")), F.lit(0.0)))
    by = copies.groupBy("copybook").agg(F.count("*").alias("uses"))
    c = by.agg(F.count("*").alias("copybooks"), F.max("uses").alias("most_used_count"))
    top = by.orderBy(F.desc("uses"), "copybook").limit(1).select(F.col("copybook").alias("most_used"))
    return d.join(c).join(top, how="left").join(circular(strong_components(plain_edges(deps))))  # one row each


def run_circular(deps: DataFrame) -> DataFrame:
    """(run_id, circular_components, circular_files) of each run that has circular dependencies among its own rows; all runs are searched together."""
    named = lambda c: F.concat_ws("/", F.col("run_id").cast("string"), F.col(c)).alias(c)
    found = strong_components(plain_edges(deps.select(named("source_file"), named("target_file")))).where("size > 1")
    run = F.split("scc", "/")[0].cast("bigint").alias("run_id")
    return found.groupBy(run).agg(F.countDistinct("scc").alias("circular_components"), F.count("*").alias("circular_files"))


def report_metrics(files: DataFrame, spent: DataFrame) -> DataFrame:
    """Files, their mean length and lines, and files a minute of the time ``spent`` (one row of minutes; at least one counts)."""
    f = files.agg(F.count("*").alias("files"), F.try_divide(F.sum(F.length("content")).cast("double"), F.count("*").cast("double")).alias("mean_length"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))
    return f.join(spent).select("files", "mean_length", "lines", (F.col("files").cast("double") / F.greatest(F.coalesce("minutes", F.lit(1.0)), F.lit(1.0))).alias("per_minute"))  # one row each


def usage_index(copies: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct ``value``s of each ``key``, sorted, as comma-joined text and as a count."""
    return copies.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("l")).select(key, F.array_join("l", ",").alias("members"), F.size("l").alias("n"))


def call_stats(api: DataFrame, *keys: str) -> DataFrame:
    """Calls, successes, failures, durations, tokens, cost in millionths; cost per 1K tokens where there are tokens."""
    out = api.groupBy(*keys).agg(F.count("*").alias("calls"), total_if(F.col("ok")).alias("succeeded"), total_if(~F.col("ok")).alias("failed"), _sum("duration_ms").alias("duration_ms"), F.min("duration_ms").alias("shortest"), F.max("duration_ms").alias("longest"), _sum("tokens").alias("tokens"), _sum("micros").alias("micros"))
    return out.withColumn("mean_ms", F.try_divide(F.col("duration_ms").cast("double"), F.col("calls").cast("double"))).withColumn("per_1k", F.coalesce(F.try_divide(F.col("micros") * 1000.0, F.col("tokens").cast("double")), F.lit(0.0)))


def small_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Programs that were not chunked, at least 0, and whether a run was direct or smart."""
    p = files.agg(total_if(~F.col("is_copybook")).alias("programs"))
    c = chunks.agg(F.countDistinct("source_file").alias("chunked"))
    both = p.join(c)  # one row each
    return both.withColumn("small", F.greatest(F.lit(0), F.col("programs") - F.col("chunked"))).withColumn("smart", F.col("chunked") > 0)


def extract_totals(extracts: DataFrame) -> DataFrame:
    """One row (stories, features, rules, copybooks, programs) over (is_copybook, stories_json, features_json, rules_json); what is no JSON array counts 0."""
    size = lambda k: F.sum(F.coalesce(F.json_array_length(f"{k}_json"), F.lit(0)).cast("bigint")).alias(k)
    return extracts.agg(*[size(k) for k in ("stories", "features", "rules")], F.count_if("is_copybook").alias("copybooks"), F.count_if(~F.col("is_copybook")).alias("programs"))
