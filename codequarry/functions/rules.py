"""Patterns as a table: loaded, checked, and handed to extraction and scoring by language and kind.

A rule is (language, kind, pattern, weight). Kinds are ``sign`` (complexity),
``copybook`` and ``call`` (the first group is the name; of calls the first rule that
fits a line counts), and ``edge:KIND`` (what a paragraph refers to as KIND). Rules of
one kind keep the table's order, ``pos``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.scalars import SIGNS

SCHEMA = "pos int, language string, kind string, pattern string, weight int"


def default_rules() -> list[tuple[int, str, str, str, int]]:
    """COBOL's rules, as the modules that use them state them."""
    from codequarry.operators.extract import CALLS, COPYBOOKS, EDGES

    found = [("sign", p, w) for p, w in SIGNS] + [("copybook", p, 0) for p in COPYBOOKS] + [("call", p, 0) for p in CALLS] + [(f"edge:{k}", p, 0) for k, p in EDGES]
    return [(i, "cobol", kind, p, w) for i, (kind, p, w) in enumerate(found)]


def load_rules(spark: SparkSession, at: str) -> DataFrame:
    """Rules from JSON lines; a rule without a weight weighs 1, one without a place comes last."""
    return spark.read.schema(SCHEMA).json(at).select(F.coalesce("pos", F.lit(2**31 - 1)).alias("pos"), F.lower("language").alias("language"), "kind", "pattern", F.coalesce("weight", F.lit(1)).alias("weight"))


def _error(spark: SparkSession, pattern: str | None) -> str | None:
    """Why the JVM can't use a pattern."""
    if not pattern:
        return "empty"
    try:
        found = spark._jvm.java.util.regex.Pattern.compile(pattern, 2).matcher("")
    except Exception as e:  # the gateway's exception for what the JVM throws
        return str(getattr(e, "java_exception", e)).split("\n")[0]
    return "matches nothing at all" if found.matches() else None


class Rules:
    """Checked rules of one language; a configuration's size, so held on the driver. ``skipped`` are (kind, pattern, reason) of those that can't be used."""

    def __init__(self, table: DataFrame, language: str = "cobol") -> None:
        rows = table.where(F.lower("language") == language.lower()).orderBy("pos", "kind", "pattern").collect()
        errors = [_error(table.sparkSession, r.pattern) for r in rows]
        self.skipped = [(r.kind, r.pattern, e) for r, e in zip(rows, errors) if e]
        self.rows = [r for r, e in zip(rows, errors) if not e]

    def patterns(self, kind: str) -> tuple[str, ...]:
        return tuple(r.pattern for r in self.rows if r.kind == kind)

    def signs(self) -> tuple[tuple[str, int], ...]:
        return tuple((r.pattern, r.weight) for r in self.rows if r.kind == "sign")

    def edges(self) -> tuple[tuple[str, str], ...]:
        return tuple((r.kind.partition(":")[2], r.pattern) for r in self.rows if r.kind.startswith("edge:"))


def anchor(pattern: str) -> str:
    """Letters that every match of a pattern begins with, in upper case; empty where it has none to go by."""
    letters = re.match(r"[A-Za-z]*", pattern)[0]
    if "|" in pattern or pattern[len(letters) : len(letters) + 1] in ("*", "?", "{"):
        letters = "" if "|" in pattern else letters[:-1]
    return letters.upper()


def counted(text: Column, upper: Column, pattern: str) -> Column:
    """Matches of a pattern, whatever the case. Most texts lack most words, and a plain search for the word is far cheaper than the pattern."""
    word = anchor(pattern)
    count = F.regexp_count(text, F.lit("(?i)" + pattern))
    return F.when(upper.contains(word), count).otherwise(0) if word else count
