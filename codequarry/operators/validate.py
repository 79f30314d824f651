"""Consistency of converted code with the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signature_issues(uses: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, issue, expected, actual, severity): uses (id, run_id, legacy_name, method, return_type, params) against the
    registry's one signature for each (run_id, legacy_name); unknown names are consistent. params are the parameters'
    types in order; they are compared by position if there are equally many."""
    r = registry.select("run_id", "legacy_name", F.col("method").alias("m"), F.col("return_type").alias("t"), F.col("params").alias("p"))
    both = uses.join(r, ["run_id", "legacy_name"])
    found = F.array(
        F.when(F.col("method") != F.col("m"), F.struct(F.lit("MethodNameMismatch").alias("issue"), F.col("m").alias("expected"), F.col("method").alias("actual"), F.lit("Error").alias("severity"))),
        F.when(F.col("return_type") != F.col("t"), F.struct(F.lit("ReturnTypeMismatch").alias("issue"), F.col("t").alias("expected"), F.col("return_type").alias("actual"), F.lit("Error").alias("severity"))),
        F.when(F.size("params") != F.size("p"), F.struct(F.lit("ParameterCountMismatch").alias("issue"), F.size("p").cast("string").alias("expected"), F.size("params").cast("string").alias("actual"), F.lit("Critical").alias("severity"))),
    )
    other = lambda x, i: F.when(x != F.get("p", i), F.struct(F.concat(F.lit("Parameter["), i.cast("string"), F.lit("].Type")).alias("issue"), F.get("p", i).alias("expected"), x.alias("actual"), F.lit("Error").alias("severity")))
    placed = F.when(F.size("params") == F.size("p"), F.transform("params", other)).otherwise(F.array())
    return both.select("id", F.explode(F.array_compact(F.concat(found, placed))).alias("i")).select("id", "i.*")


def type_issues(uses: DataFrame, mappings: DataFrame) -> DataFrame:
    """(id, severity): Error for another type, Warning for another field name; absent or equal mappings give no row."""
    m = mappings.select("key", F.col("type").alias("_t"), F.col("field").alias("_f"))
    severity = F.when(F.col("type") != F.col("_t"), "Error").when(F.col("field") != F.col("_f"), "Warning")
    return uses.join(m, "key", "left").select("id", severity.alias("severity")).where("severity is not null")


#: Severities from low to high.
SEVERITIES = ("Info", "Warning", "Error", "Critical")


def severity_rank(column: str):
    out = F.lit(-1)
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.col(column) == s, i).otherwise(out)
    return out


def validity(issues: DataFrame, *keys: str) -> DataFrame:
    """Valid by ``keys`` if no issue is an Error or worse."""
    return issues.groupBy(*keys).agg(F.max(severity_rank("severity")).alias("worst")).withColumn("valid", F.col("worst") < 2)


def leaks(names: DataFrame, code: DataFrame) -> DataFrame:
    """(file, name): legacy names that the file's converted code still holds, with or without hyphens, whatever the case.

    A file's names come together and are looked for in each of its texts, so that no text is copied for each name.
    """
    own = names.where("name is not null").groupBy("file").agg(F.collect_set("name").alias("names"))
    hit = lambda n: F.contains(F.lower("code"), F.lower(n)) | F.contains(F.lower("code"), F.replace(F.lower(n), F.lit("-"), F.lit("")))
    return code.join(own, "file").select("file", F.explode(F.filter("names", hit)).alias("name")).distinct()


def unconverted(signatures: DataFrame, code: DataFrame) -> DataFrame:
    """(file, name, severity): legacy names (file, name, method) that the file's code holds without hyphens, whatever the case, while it never calls their method."""
    own = signatures.groupBy("file").agg(F.collect_set(F.struct("name", "method")).alias("names"))
    held = lambda n: F.contains(F.lower("code"), F.lower(F.replace(n["name"], F.lit("-"), F.lit("")))) & ~F.contains("code", F.concat(n["method"], F.lit("(")))
    return code.join(own, "file").select("file", F.explode(F.transform(F.filter("names", held), lambda n: n["name"])).alias("name"), F.lit("Warning").alias("severity")).distinct()


def fix_plan(issues: DataFrame, most: int) -> DataFrame:
    """The first ``most`` issues by run: signature issues before types, then by id."""
    from pyspark.sql import Window

    first = F.when(F.col("issue") == "TypeMismatch", 1).otherwise(0)
    n = F.row_number().over(Window.partitionBy("run_id").orderBy(first, "id", "issue"))
    return issues.withColumn("n", n).where(F.col("n") <= most)


def unflagged(uses: DataFrame, issues: DataFrame) -> DataFrame:
    """(run_id, ok) of every use (id, run_id): ok if none of ``issues`` (id) is about it."""
    flagged = issues.select("id").distinct().withColumn("bad", F.lit(True))
    return uses.join(flagged, "id", "left").select("run_id", F.col("bad").isNull().alias("ok"))


def consistency(methods: DataFrame, variables: DataFrame, refs: DataFrame) -> DataFrame:
    """(run_id, methods, variables, refs) in percent: the shares of rows (run_id, ok) that are consistent; 100 for a run without rows of a kind."""
    kinds = {"methods": methods, "variables": variables, "refs": refs}
    rows = None
    for kind, df in kinds.items():
        one = df.select("run_id", F.lit(kind).alias("kind"), F.col("ok").cast("boolean").alias("ok"))
        rows = one if rows is None else rows.unionByName(one)
    share = lambda k: F.coalesce(F.try_divide(100.0 * F.count_if((F.col("kind") == k) & F.col("ok")), F.count_if(F.col("kind") == k)), F.lit(100.0))
    return rows.groupBy("run_id").agg(*[share(k).alias(k) for k in kinds])
