"""Rules as a table."""

import json

import pytest
from pyspark.sql import functions as F

from codequarry.functions import rules as R
from codequarry.functions.scalars import SIGNS, complexity
from codequarry.operators import extract as X
from tests.programs import SOURCES


def test_broken_rules_are_reported_and_skipped(spark, tmp_path):
    lines = [("cobol", "sign", "GOOD", 5), ("COBOL", "sign", "(BAD", 1), ("cobol", "sign", "a*", 1), ("pl1", "call", r"CALL\s+(\w+)", None), ("cobol", "sign", None, 1), ("cobol", "edge:USE", r"USE\s+(\w+)", 0)]
    (tmp_path / "rules.json").write_text("\n".join(json.dumps(dict(zip(("language", "kind", "pattern", "weight"), x))) for x in lines))
    table = R.load_rules(spark, str(tmp_path / "rules.json"))
    cobol = R.Rules(table)
    assert cobol.signs() == (("GOOD", 5),) and cobol.edges() == (("USE", r"USE\s+(\w+)"),)
    assert {p for _, p, _ in cobol.skipped} == {"(BAD", "a*", None} and any("nclosed" in e for _, _, e in cobol.skipped)
    assert R.Rules(table, "PL1").patterns("call") == (r"CALL\s+(\w+)",) and R.Rules(table, "none").rows == []


def test_rules_of_a_language_lead_extraction(spark):
    s = spark.createDataFrame([("a.cbl", "FETCH one;\nUSE two\n       MAIN.\n  USE three")], "file string, content string")
    assert [r.program for r in X.calls(s, (r"FETCH\s+(\w+)",)).collect()] == ["one.cbl"]
    assert [(r.caller, r.callee, r.kind) for r in X.call_edges(s, (("USE", r"USE\s+(\w+)"),)).collect()] == [("MAIN", "three", "USE")]


def test_default_rules_are_the_modules_own(spark):
    all_ = R.Rules(spark.createDataFrame(R.default_rules(), R.SCHEMA))
    assert not all_.skipped and all_.signs() == SIGNS and all_.patterns("copybook") == X.COPYBOOKS and all_.edges() == X.EDGES


@pytest.mark.parametrize("pattern,word", [(r"EXEC\s+SQL", "EXEC"), ("REDEFINES", "REDEFINES"), (r"STRING\b", "STRING"), ("ab*c", "A"), ("x|y", ""), (r"\bA", ""), ("ab+", "AB"), ("ab?", "A")])
def test_anchors(pattern, word):
    assert R.anchor(pattern) == word


def test_anchored_counts_are_plain_counts(spark):
    s = spark.createDataFrame([(c,) for _, c in SOURCES] + [("unstring x string y Exec sql perform until occurs 5 times",), ("",), (None,)], "t string")
    plain = sum((F.regexp_count("t", F.lit("(?i)" + p)) * w for p, w in SIGNS), F.lit(0))
    quick = sum((R.counted(F.col("t"), F.upper("t"), p) * w for p, w in SIGNS), F.lit(0))
    assert all(r.a == r.b or r.a is None for r in s.select(plain.alias("a"), quick.alias("b")).collect())
    assert [r.c for r in s.where("t is null or t = ''").select(complexity(F.col("t")).alias("c")).collect()] == [0] * s.where("t is null or t = ''").count()
