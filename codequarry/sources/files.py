"""Readers of source trees, logs and glossaries, and writers of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.staging import carried, numbered

LOG = "timestamp string, category string, message string, data string"


def source_tree(spark: SparkSession, at: str) -> DataFrame:
    """(path, file, content, is_copybook) of all .cbl and .cpy files below ``at``."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{cbl,cpy}").text(at, wholetext=True)
    path = F.col("_metadata.file_path")
    return text.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("file"), F.col("value").alias("content")).withColumn("is_copybook", F.lower("file").endswith(".cpy"))


def can_process(files: DataFrame) -> DataFrame:
    """Files with a COBOL suffix or a division header."""
    return files.where(F.col("file").rlike(r"(?i)\.(cbl|cob|cobol|cpy)$") | F.col("content").rlike(r"(?i)(IDENTIFICATION|PROCEDURE|DATA)\s+DIVISION"))


def json_lines(spark: SparkSession, *paths: str, schema: str = LOG) -> DataFrame:
    """One JSON object a line from all paths; malformed lines are left out."""
    rows = spark.read.text(list(paths)).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    return rows.where(F.col("r").isNotNull() & F.coalesce(F.col("r.timestamp"), F.col("r.message")).isNotNull()).select("r.*")


_BETWEEN = r"(?<=\})\s*\n\s*\n\s*(?=\{)"


def json_blocks(spark: SparkSession, at: str, schema: str = LOG) -> DataFrame:
    """JSON objects that blank lines separate; an object may hold blank lines itself. Malformed ones are left out.

    Files are read in records up to an empty line, so a large file is many rows in
    many tasks. Blank lines with white space separate within a record; records that
    the reader has cut inside an object are put together again, with those before.
    """
    text = spark.read.option("lineSep", "\n\n").text(at)
    records = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> ''")
    rows = numbered(records, "path", "start", "id")
    before = rows.select((F.col("n") + 1).alias("n"), F.col("path").alias("path_before"), F.col("value").endswith("}").alias("closed"))
    begins = F.coalesce((F.col("path") != F.col("path_before")) | (F.col("closed") & F.col("value").startswith("{")), F.lit(True))
    rows = carried(rows.join(before, "n", "left").select("n", "path", "value", F.when(begins, F.col("n")).alias("first")), "first")
    whole = rows.groupBy("path", "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "\n\n").alias("value"))
    return whole.select(F.explode(F.split("value", _BETWEEN)).alias("block")).select(F.from_json("block", schema).alias("r")).where("r is not null").select("r.*")


def latest_files(spark: SparkSession, at: str, n: int, by: str = "path") -> list[str]:
    """The last ``n`` files by name (``path``) or by ``modificationTime``; contents are not read."""
    listed = spark.read.format("binaryFile").load(at).select("path", "modificationTime")
    return [r.path for r in listed.orderBy(F.desc(by), F.desc("path")).limit(n).collect()]


def tail(spark: SparkSession, path: str, n: int = 500) -> DataFrame:
    """(line, text) of a file's last ``n`` lines. The file is read a line a row; each task keeps its last ``n``."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("text"))
    last = rows.orderBy(F.desc("start"), F.desc("id")).limit(n)
    line = F.lit(rows.count()) + 1 - F.row_number().over(Window.orderBy(F.desc("start"), F.desc("id")))  # over n rows
    return last.select(line.cast("int").alias("line"), "text").orderBy("line")


def newest_entries(spark: SparkSession, at: str, n: int = 5, schema: str = LOG) -> DataFrame:
    """JSON entries in the last ``n`` lines of the file changed last."""
    newest = latest_files(spark, at, 1, "modificationTime")
    if not newest:
        return spark.createDataFrame([], schema)
    return tail(spark, newest[0], n).where("trim(text) like '{%'").select(F.from_json("text", schema).alias("r")).where("r is not null").select("r.*")


def glossary(spark: SparkSession, at: str) -> DataFrame:
    """(term, translation)"""
    return spark.read.option("multiLine", True).schema("terms array<struct<term:string,translation:string>>").json(at).select(F.explode("terms").alias("t")).select("t.*")


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def write_report(df: DataFrame, at: str, kind: str = "json") -> None:
    """JSON lines, or for ``text`` one column of lines in their order.

    Ordered rows are in ranges already, and each range is written by a task of its own:
    part files in the order of their names, one after the other, are the report.
    ``read_index`` says where in it each of them begins.
    """
    if kind != "text":
        df.write.mode("overwrite").json(at)
        return
    df.write.mode("overwrite").text(at)
    spark, name = df.sparkSession, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    parts = spark.read.text(at).groupBy(name.alias("part")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a part file
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    parts.select("part", (before("lines") + 1).alias("first_line"), "lines", before("bytes").alias("offset"), "bytes").write.mode("overwrite").json(f"{at.rstrip('/')}/_index")


def read_index(spark: SparkSession, at: str) -> DataFrame:
    """(part, first_line, lines, offset, bytes) of a text report's part files."""
    return spark.read.schema("part string, first_line bigint, lines bigint, offset bigint, bytes bigint").json(f"{at.rstrip('/')}/_index")


def report_lines(spark: SparkSession, at: str, first: int, last: int) -> DataFrame:
    """(line, value) of a text report's lines ``first`` to ``last``; only part files that hold some of them are read."""
    held = read_index(spark, at).where((F.col("first_line") <= last) & (F.col("first_line") + F.col("lines") > first)).collect()
    out = spark.createDataFrame([], "line bigint, value string")
    for r in held:
        rows = spark.read.text(f"{at.rstrip('/')}/{r.part}").select(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
        out = out.union(numbered(rows, "start", "id").select((F.col("n") + r.first_line - 1).alias("line"), "value"))
    return out.where(F.col("line").between(first, last))


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """Lines of a Markdown table of ``df``: a heading, a rule, and the rows by ``order``."""
    head = " | ".join(df.columns)
    key = F.struct(*order)
    rows = df.select(F.lit(2).alias("n"), key.alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))
    top = df.sparkSession.createDataFrame([(0, f"| {head} |"), (1, "|" + "---|" * len(df.columns))], "n int, value string")
    return rows.unionByName(top.withColumn("k", F.lit(None).cast(rows.schema["k"].dataType))).orderBy("n", "k").select("value")
