"""Operators on small authored inputs: known results, nulls, ties, empty tables."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from codequarry import registry
from codequarry.functions import scalars as S
from codequarry.operators import chunking as C
from codequarry.operators import dml as D
from codequarry.operators import extract as X
from codequarry.operators import filters as P
from codequarry.operators import graph as G
from codequarry.operators import validate as V
from codequarry.operators.aggregates import chunk_status, resume_point
from tests.programs import SOURCES
from codequarry.staging import numbered
from codequarry.streaming.logs import minute_counts


def tuples(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def sources(spark):
    return spark.createDataFrame(SOURCES, "file string, content string")


def test_windows_of_5000_lines(spark):
    out = tuples(C.windows(spark.createDataFrame([(1, 5000)], "id int, lines int"), 1000, 100).select("start_line", "end_line"), "start_line")
    assert [a for a, _ in out] == [1, 901, 1801, 2701, 3601, 4501] and out[-1][1] == 5000


def test_packing(spark):
    ten = spark.createDataFrame([("a", i, "paragraph", 50, 500) for i in range(10)], "file string, pos int, kind string, lines int, tokens int")
    assert [r.chunk for r in C.packed(ten, 100, 4000).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    cut = spark.createDataFrame([("a", 0, "section", 40, 1), ("a", 1, "paragraph", 40, 1), ("a", 2, "other", 40, 1)], ten.schema)
    assert [r.chunk for r in C.packed(cut, 100, 4000).orderBy("pos").collect()] == [0, 1, 1]  # the chunk ends with its section
    long = spark.createDataFrame([("a", 0, "other", 200, 1), ("a", 1, "other", 10, 1), ("b", 0, "other", 10, 1)], ten.schema)
    assert [(r.file, r.chunk) for r in C.packed(long, 100, 4000).orderBy("file", "pos").collect()] == [("a", 0), ("a", 1), ("b", 0)]
    assert C.packed(ten.where("false")).count() == 0


def test_packing_of_many_files(spark):
    """Against the rule on indices: of the units since the last cut, the last one of the highest rank ends the chunk."""
    rng, rank = random.Random(3), {"division": 3, "section": 2, "paragraph": 1, "other": 0}
    units = [(f"f{f}", i, rng.choice([*rank]), rng.randrange(1, 90), rng.randrange(1, 50)) for f in range(6) for i in range(80)]
    want = {}
    for f in range(6):
        u, first, cuts = [x for x in units if x[0] == f"f{f}"], 0, []
        total = lambda a, b: (sum(x[3] for x in u[a:b]), sum(x[4] for x in u[a:b]))  # noqa: E731,B023
        for i in range(len(u)):
            lines, tokens = total(first, i + 1)
            if (lines > 100 or tokens > 90) and i >= first:
                last = max(range(first, i), key=lambda j: (rank[u[j][2]], j)) if i > first else i  # noqa: B023
                cuts.append(last)
                first = last + 1
        for i in range(len(u)):
            want[f"f{f}", i] = sum(c < i for c in cuts)
    got = C.packed(spark.createDataFrame(units, "file string, pos int, kind string, lines int, tokens int"), 100, 90).collect()
    assert {(r.file, r.pos): r.chunk for r in got} == want


def test_plans_that_fail(spark):
    plan = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 11, 20)], "id int, chunk int, start_line int, end_line int")
    files = spark.createDataFrame([(1,)], "id int")
    assert C.checked(C.plan_summary(plan, 10), files, 10).count() == 1
    for bad, of in ((plan, files.union(spark.createDataFrame([(2,)], "id int"))), (plan.withColumn("end_line", F.lit(99)), files)):
        with pytest.raises(Exception, match="no valid chunks"):
            C.checked(C.plan_summary(bad, 10), of, 10).collect()


def test_several_tables_change_together(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    D.commit_run(spark, {"dependencies": rows("a"), "metrics": rows("m")}, 1, at)
    D.commit_run(spark, {"dependencies": rows("b", "c"), "metrics": rows("n")}, 1, at)
    rows("lost").write.parquet(f"{at}/dependencies/run=1/attempt-without-pointer")
    assert {r.v for r in D.read_run(spark, at, "dependencies", 1).collect()} == {"b", "c"} and D.read_run(spark, at, "metrics", 1).first().v == "n"


def test_deep_levels_are_not_cycles(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)] + [("x", "y"), ("y", "x")], "src string, dst string")
    out = {r.file: r.level for r in G.levels(e, e.select(F.col("src").alias("file")).union(e.select("dst"))).collect()}
    assert out["n0"] == 30 and out["n30"] == 0 and out["x"] is None


def test_long_cycles(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)], "src string, dst string")
    assert [(r.start, r.length) for r in G.cycles(ring).collect()] == [(f"n{i}", 9) for i in range(9)]
    assert G.cycles(ring, limit=3).count() == 3 and G.cycles(ring, depth=8).count() == 0


def test_numbers_over_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("x"))
    assert [r.n for r in numbered(df, "x").orderBy("x").collect()] == list(range(1, 1001))


def test_resume_and_totals_of_nothing(spark):
    none = spark.createDataFrame([], "run_id int, source_file string, chunk_index int, status string, processing_time_ms long, tokens_used long")
    assert resume_point(none).first()[0] == -1
    assert chunk_status(none).first()[:6] == (0, 0, 0, 0, 0, 0)


def test_upsert_keeps_what_it_must(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, status string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 7)], "k int, status string, n int")
    assert tuples(D.upsert(base, new, ["k"], ["status"]), "k") == [(1, "a", 5), (2, None, 6), (3, "c", 7)]


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, seq int, v string")
    assert D.first_wins(rows, ["k"], "seq").first().v == "old" and D.last_wins(rows, ["k"], "seq").first().v == "new"


def test_patch_and_stale(spark):
    runs = spark.createDataFrame([(1, "Running", dt.datetime(2024, 1, 1)), (2, "Running", dt.datetime(2024, 1, 2)), (3, None, dt.datetime(2024, 1, 1))], "id int, status string, started_at timestamp")
    assert [r.status for r in D.cancel_stale(runs, dt.datetime(2024, 1, 2, 0, 30)).orderBy("id").collect()] == ["Cancelled", "Running", None]
    assert D.patch(runs, runs.limit(0).select("id", "status"), ["id"]).count() == 3


def test_committed_runs_only(spark, tmp_path):
    at = str(tmp_path / "t")
    D.write_run(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, v string"), at)
    D.write_run(spark.createDataFrame([(2, "c")], "run_id int, v string"), at)
    assert tuples(D.read_committed(spark, at).select("run_id", "v"), "run_id") == [(1, "a"), (2, "c")]


def test_trails_are_edge_unique(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("C", "A"), ("B", "D")], "src string, dst string")
    found = G.cycles(e, 10, None).groupBy("length").count().orderBy("length").collect()
    assert [(r[0], r[1]) for r in found] == [(2, 4), (4, 4)]


def test_reach_lists_every_distance(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "C")], "src string, dst string")
    out = G.reach(e, spark.createDataFrame([("A",)], "file string"))
    assert tuples(out, "file", "distance") == [("A", "B", 1), ("A", "C", 1), ("A", "C", 2)]
    assert tuples(G.nearest(out), "file") == [("A", "B", 1), ("A", "C", 1)]


def test_levels_leave_cycles_null(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    nodes = e.select(F.col("src").alias("file")).union(e.select("dst"))
    assert tuples(G.levels(e, nodes).drop("state"), "file") == [("a", 2), ("b", 1), ("c", 0), ("x", None), ("y", None)]


def test_search_without_term(spark):
    f = spark.createDataFrame([("a", None), (None, "x%y")], "file_name string, content string")
    assert P.search(f, " ").count() == 2 and P.search(f, "X").count() == 1


def test_extraction_of_the_samples(spark):
    s = sources(spark)
    assert {tuple(r) for r in X.copybooks(s).collect()} == {("orders.cbl", "ORDER-REC.cpy"), ("orders.cbl", "OLD-REC.cpy"), ("show.cbl", "STOCK-REC.cpy"), ("show.cbl", "SQLCA.cpy")}
    assert {(r.file, r.program) for r in X.calls(s).collect()} == {("orders.cbl", "PRICE-IT.cbl")}
    assert {r.table for r in X.sql_tables(s).collect()} == {"CUSTOMER", "ADDRESS", "STOCK", "SQLCA"}
    assert {(r.verb, r.name) for r in X.file_io(s).collect()} == {("OPEN", "ORDER-FILE"), ("READ", "ORDER-FILE"), ("CLOSE", "ORDER-FILE"), ("WRITE", "OUT-REC")}


def one_file(spark, content, name="x.cbl"):
    return spark.createDataFrame([(name, content)], "file string, content string")


def test_rules_of_references(spark):
    s = one_file(spark, "INCLUDE MEM1\ncopy my_copy.\nCOPY 'quoted'\nCALL SUB-A\nCALL sub-b USING X\ncall \"Q_1\" CALL 'Z'\n      * CALL 'IN-COMMENT'")
    assert {r.copybook for r in X.copybooks(s).collect()} == {"MEM1.cpy", "my_copy.cpy", "quoted.cpy"}
    assert {(r.line, r.program) for r in X.calls(s).collect()} == {(5, "sub-b.cbl"), (6, "Z.cbl"), (7, "IN-COMMENT.cbl")}
    other = one_file(spark, "COPY A1\nCALL 'B1'", "x.cpy")
    assert X.copybooks(other).count() == X.calls(other).count() == X.dependencies(other).count() == 0


def test_rules_of_sql_blocks(spark):
    s = one_file(spark, "\n".join(["  EXEC SQL select a from t_1", "  INTO VALUES, A", "  END-EXEC", "  READ F-1", "  EXEC SQL UPDATE LOST", "  READ NOT-SEEN", "  exec sql INSERT INTO T2 END-EXEC", "  OPEN F-2", "  OPEN I-O F-3", "  EXEC CICS LINK PROGRAM('p-1') END-EXEC", "  LINK PROGRAM('P-2')", "      *EXEC SQL FROM T9 END-EXEC", "  EXEC SQL FROM OPEN1", "  CLOSE NEVER"]))
    assert {(r.line, r.table) for r in X.sql_tables(s).collect()} == {(1, "T_1"), (1, "VALUES"), (7, "T2")}
    joined = one_file(spark, "EXEC SQL SELECT 1 XFROM T1 END-EXEC")
    assert [r.table for r in X.sql_tables(joined).collect()] == ["T1"] and X.sql_tables(joined, whole_words=True).count() == 0
    assert {tuple(r)[1:] for r in X.file_io(s).collect()} == {(4, "READ", "F-1"), (9, "OPEN", "F-3")}
    assert [tuple(r)[1:] for r in X.cics_links(s).collect()] == [(10, "p-1")]


def test_call_edges(spark):
    s = one_file(spark, "           PERFORM BEFORE\n       Main-Para.\n           PERFORM UNTIL X CALL SUB-A\n           GO TO End-It. CALL 'q'\n       X SECTION.\n           PERFORM Z\n       end-it.\n      *    perform c")
    assert [tuple(r)[1:] for r in X.call_edges(s).orderBy("line", "kind", "callee").collect()] == [(3, "Main-Para", "SUB-A", "CALL"), (3, "Main-Para", "UNTIL", "PERFORM"), (4, "Main-Para", "q", "CALL"), (4, "Main-Para", "End-It", "GO TO"), (6, "Main-Para", "Z", "PERFORM"), (8, "end-it", "c", "PERFORM")]


def test_units_and_variables(spark):
    s = sources(spark).where("file = 'orders.cbl'")
    u = {r.unit: r for r in X.units(s).collect()}
    assert (u["PARAGRAPH:READ-ORDER"].section, u["PARAGRAPH:READ-ORDER"].parent) == ("MAIN-LINE", "SECTION:MAIN-LINE") and u["PARAGRAPH:FIND-CUSTOMER"].section == "LOOK-UP"
    assert (u["SECTION:WORKING-STORAGE"].kind, u["SECTION:WORKING-STORAGE"].parent) == ("data section", "DATA-DIVISION") and u["SECTION:MAIN-LINE"].parent == "PROCEDURE-DIVISION" and u["DATA-DIVISION"].parent is None
    text = s.first().content.split("\n")
    for r in u.values():
        assert r.chars == len("\n".join(text[r.start_line - 1 : r.end_line]))
    assert u["PROCEDURE-DIVISION"].end_line == len(text) and u["PARAGRAPH:START-UP"].end_line == u["PARAGRAPH:READ-ORDER"].start_line - 1
    v = {r.name: (r.level, r.parent, r.value) for r in X.variables(s).collect()}
    assert v["WS-QTY"] == (10, "WS-LINES", None) and v["WS-NAME"] == (5, "WS-ORDER", None) and v["WS-DONE"] == (1, None, "'N'")
    assert X.units(s, strict_area_a=True).where("kind = 'paragraph'").count() == 4


def test_clauses_of_data_entries(spark):
    from tests.programs import CLAUSES

    got = {r.name: r for r in X.variables(one_file(spark, CLAUSES)).collect()}
    of = lambda n: tuple(getattr(got[n], c) for c in ("line", "level", "pic", "usage", "value", "occurs", "depending", "redefines", "is_group", "parent"))
    assert of("WS-REC") == (3, 1, None, None, None, None, None, None, True, None)
    assert of("QTY") == (4, 5, "S9(4)", "COMP", None, None, None, None, False, "WS-REC")
    assert of("TOTAL-X") == (5, 5, "S9(7)V99", "COMP-3", "ZERO", None, None, None, False, "WS-REC")
    assert of("RATE") == (9, 5, None, "COMP-2", None, None, None, None, False, "WS-REC")
    assert of("TAB") == (10, 5, None, None, None, 50, "QTY", None, True, "WS-REC")
    assert of("CELL") == (12, 10, "X(3)", None, "'A. B'", None, None, None, False, "TAB") and of("CELL-2")[:3] == (12, 10, "9") and of("CELL-2")[-1] == "TAB"
    assert of("AS-TEXT") == (13, 5, "X(5)", None, None, None, None, "TOTAL-X", False, "WS-REC")
    assert of("DONE") == (17, 77, "X", None, '"Y.N"', None, None, None, False, "WS-REC")
    assert "IS-BIG" not in got and of("FILLER")[2:3] == ("X",) and set(got) == {"WS-REC", "QTY", "TOTAL-X", "RATE", "TAB", "CELL", "CELL-2", "AS-TEXT", "FILLER", "DONE"}


ODD_ENTRIES = [
    "01  A PIC X.  05 B VALUE 'DON. T. 05 C PIC 9.",
    "01  A PIC X(3)..  05 B PIC X. .  05 C.'X. 05 D PIC 9.",
    "01  A PIC X.\t05 B PIC\t9. \r",
    '01  A VALUE "X. Y" PIC X. 05 B "WS. 05 C PIC X.',
    "01  A\x0bB PIC X. 05 C PIC X.\x0b05 D PIC 9.",
    "01  A VALUE IT'S. 05  B VALUE '' PIC X. 05 C OCCURS 3 TO 9.",
]


def test_odd_entries_like_the_sql(spark):
    import duckdb

    from codequarry.plans.text import _items

    texts = [*ODD_ENTRIES, "\n".join("       " + x for x in ODD_ENTRIES)]
    rows = [(f"{i}.cbl", t if i >= len(ODD_ENTRIES) else "       " + t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("create table sources(file varchar, content varchar)")
    con.executemany("insert into sources values (?, ?)", rows)
    want = sorted(map(repr, con.execute("with " + _items).fetchall()))
    got = sorted(repr(tuple(r)) for r in X.entries(spark.createDataFrame(rows, "file string, content string")).drop("sentence").collect())
    assert got == want and len(got) > 12


def test_mentioned_files_like_a_loop(spark):
    import random

    from codequarry.operators import filters as P

    rng = random.Random(5)
    names = ["doc_7.cbl", "doc_77.cpy", "DOC_77.cbl", "ab.c.cbl", "ümlaut-größe.cbl", "x.cbl", "a\U0001f600b.cpy", "no_dot", "long_long_name_12345.cbl", "other_long_name_12345.cbl", None]
    stems = {n: n.lower().rsplit(".", 1)[0] for n in names if n}
    words = ["Doc_7", "doc_77", "AB.C", "ÜMLAUT-GRÖSSE", "ümlaut-größe", "X", "a\U0001f600B", "NO_DOT", "long_name_12345", "Long_Long_Name_12345", "zz", "", "q " * 300]
    texts = [(f"p{i}", "".join(rng.choice(words) + rng.choice(["", " ", "_"]) for _ in range(rng.randint(0, 5)))) for i in range(120)] + [("none", None)]
    df = P.mentioned(spark.createDataFrame(texts, "prompt string, text string"), spark.createDataFrame([(n,) for n in names], "file_name string"), most=3)
    want = [(p, n) for p, t in texts if t is not None for n in sorted(n for n, s in stems.items() if s in t.lower())[:3]]
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "explode" not in plan


def test_types_and_names(spark):
    df = spark.createDataFrame([("PIC 9(8)",), ("PIC X(50)",), ("PIC S9(9)V99",), ("PIC X",), (None,)], "p string")
    assert [r[0] for r in df.select(S.target_type(F.col("p"))).collect()][:4] == ["int", "String", "BigDecimal", "String"]
    one = spark.range(1)
    assert one.select(S.legacy_name(F.lit("WS-CLASS"))).first()[0] == "class_" and one.select(S.class_name(F.lit(""))).first()[0] == "ConvertedCobolProgram"


def test_validity_and_fix_cap(spark):
    issues = spark.createDataFrame([(1, i, "TypeMismatch" if i < 3 else "MethodNameMismatch", "Warning") for i in range(5)], "run_id int, id int, issue string, severity string")
    assert V.validity(issues, "run_id").first().valid
    assert [r.id for r in V.fix_plan(issues, 2).orderBy("n").collect()] == [3, 4]


def test_anchored_minute(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", i, t + dt.timedelta(seconds=s)) for i, s in enumerate((50, 70, 109, 110, 200))], "agent string, id int, ts timestamp")
    assert [r.used for r in minute_counts(rows).orderBy("id").collect()] == [1, 2, 3, 1, 1]


CHUNK = "source_file string, chunk_index int, start_line int, end_line int, status string, units array<string>"


def test_history_keeps_last_chunks_in_full(spark):
    units = [f"U{k}" for k in range(7)]
    rows = spark.createDataFrame([("a", k, 1, 2, "Completed", units if k == 0 else ["X"]) for k in range(5)] + [("b", 0, 1, 2, "Failed", [])], CHUNK)
    current = spark.createDataFrame([("a", 4), ("b", 1)], "source_file string, current int")
    out = tuples(C.history(rows, current), "source_file", "chunk_index")
    full = "// Chunk {}: Completed\n//   - X\n"
    assert out == [("a", 0, "// Chunk 0: Completed - 7 units: U0, U1, U2, U3, U4...\n"), *(("a", k, full.format(k)) for k in (1, 2, 3)), ("b", 0, "// Chunk 0: Failed\n")]


def test_context_counts_what_earlier_chunks_left(spark):
    rows = spark.createDataFrame([("a.cbl", k, k * 10 + 1, k * 10 + 10, "Completed", ["X"]) for k in range(2)], CHUNK)
    at = "source_file string, chunk_index int"
    sigs = spark.createDataFrame([("a.cbl", 0, "void a()"), ("a.cbl", 1, "void b()")], at + ", target_signature string")
    maps, refs = spark.createDataFrame([("a.cbl", 0)] * 2, at), spark.createDataFrame([("a.cbl", 0)], at)
    summary = "Processing chunk {} of 2 from a.cbl (lines {}). Contains 1 semantic units."
    heading = len(C.HISTORY_HEADING) + len("// Chunk 0: Completed\n//   - X\n")
    second = len(summary.format(2, "11-20")) // 4 + 8 // 4 + 20 + 2 * 30 + heading // 4 + 40
    assert tuples(C.context(rows, sigs, maps, refs), "chunk_index") == [("a.cbl", 0, 0, 0, 0, len(summary.format(1, "1-10")) // 4), ("a.cbl", 1, 1, 2, 1, second)]
    assert C.context(rows.limit(0), sigs, maps, refs).count() == 0


def test_assembled_chunks_name_what_crosses_them(spark):
    units = spark.createDataFrame([("f", 0, 0, "MAIN", 1, 5), ("f", 0, 1, "Init", 6, 9), ("f", 1, 2, "CALC", 10, 20)], "file string, chunk int, pos int, name string, start_line int, end_line int")
    links = spark.createDataFrame([("f", "MAIN", "init"), ("f", "MAIN", "calc"), ("f", "main", "calc"), ("f", "INIT", "LIB"), ("g", "MAIN", "OTHER")], "file string, source string, target string")
    out = tuples(C.assembled(units, links).select("chunk", "start_line", "end_line", "units", "outbound", "inbound"), "chunk")
    assert out == [(0, 1, 9, ["MAIN", "Init"], ["LIB", "calc"], []), (1, 10, 20, ["CALC"], [], ["MAIN", "main"])]


def test_signatures_compare_parameters_by_place(spark):
    kind = "id int, run_id int, legacy_name string, method string, return_type string, params array<string>"
    registry = spark.createDataFrame([(0, 1, "P", "p", "int", ["int", "String"])], kind)
    uses = spark.createDataFrame([(1, 1, "P", "p", "int", ["int", "int"]), (2, 1, "P", "p", "int", ["String"]), (3, 1, "P", "p", "int", ["int", "String"]), (4, 1, "Q", "q", "int", [])], kind)
    issues = V.signature_issues(uses, registry)
    assert tuples(issues, "id") == [(1, "Parameter[1].Type", "String", "int", "Error"), (2, "ParameterCountMismatch", "2", "1", "Critical")]
    ok = V.unflagged(uses, issues)
    assert tuples(V.consistency(ok, ok.limit(0), spark.createDataFrame([(2, True)], "run_id int, ok boolean")), "run_id") == [(1, 50.0, 100.0, 100.0), (2, 100.0, 100.0, 100.0)]


def test_reply_entries(spark):
    text = """## Business Purpose
Pays the
staff.

### Use Case 1: Pay:
**Trigger:** Month end
**Description:** Sum hours
and pay.
**Key Steps:**
1. Read
- Write
note
### Feature: Payroll
Description: First
Description: Last
- step
## Business Rules
- **Hours** are positive
- no
• Rates exist
## Notes
- not a rule"""
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "### Nothing\n- x")], "id int, text string")
    assert sorted((r.kind, r.n, r.title, r.role, r.text, r["items"]) for r in X.reply_entries(rows).collect()) == [
        ("feature", 1, "Payroll", None, "Last", ["step", "**Hours** are positive", "no", "Rates exist", "not a rule"]),
        ("purpose", 1, None, None, "Pays the staff.", []),
        ("rule", 1, None, None, "Hours are positive", []),
        ("rule", 2, None, None, "Rates exist", []),
        ("story", 1, "Use Case 1: Pay", "Month end", "Sum hours and pay.", ["Read", "Write", "step", "**Hours** are positive", "no", "not a rule"]),
    ]


def test_merged_logic(spark):
    kind = "file string, chunk int, kind string, n long, title string, role string, text string, items array<string>"
    rows = [("f", 1, "story", 1, "B", None, "", []), ("f", 0, "story", 2, "A2", "r", "t", ["x"]), ("f", 0, "story", 1, "A1", None, "", []), ("f", 1, "feature", 1, "F", None, "", []), ("f", 0, "rule", 1, None, None, "same", []), ("f", 1, "rule", 1, None, None, "same", []), ("f", 1, "rule", 2, None, None, "other", []),
            ("f", 0, "purpose", 1, None, None, "aim", []), ("f", 1, "purpose", 1, None, None, "aim", []), ("f", 2, "purpose", 1, None, None, "an ERROR", [])]
    replies = spark.createDataFrame([("f", c) for c in range(3)] + [("g", 0)], "file string, chunk int")
    got = [(r.file, r.kind, r.id, r.title or r.text) for r in X.merged_logic(spark.createDataFrame(rows, kind), replies).orderBy("file", "kind", "id").collect()]
    assert got == [("f", "feature", "F-1", "F"), ("f", "purpose", None, "Extracted from 3 chunks. aim"), ("f", "rule", "BR-1", "same"), ("f", "rule", "BR-2", "other"), ("f", "story", "US-1", "A1"), ("f", "story", "US-2", "A2"), ("f", "story", "US-3", "B"), ("g", "purpose", None, "Extracted from 1 chunks. ")]


def test_calls_name_the_words_of_the_text(spark, tmp_path):
    docs = [(1, "x and alpha y and beta-2 z and alpha", "en"), (2, "the one and of two and 5", "en"), (3, "x and alpha y", "de"), (4, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["t3_calls"](spark, str(tmp_path))
    assert tuples(got, "file", "line") == [("doc_1.cbl", 2, "alpha.cbl"), ("doc_1.cbl", 3, "beta-2.cbl"), ("doc_2.cbl", 2, "of.cbl"), ("doc_2.cbl", 3, "PROG-A.cbl")]  # a number is no name
