"""Readers, writers and streams on small files."""

import datetime as dt
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from codequarry.sources import files as R
from codequarry.staging import carried
from codequarry.streaming import live
from codequarry.streaming import logs as L


def test_source_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.cbl").write_text("ONE\nTWO\n")
    (tmp_path / "a/b/y.cpy").write_text("C")
    (tmp_path / "a/z.txt").write_text("no")
    got = {r.file: (r.content, r.is_copybook) for r in R.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"x.cbl": ("ONE\nTWO\n", False), "y.cpy": ("C", True)}
    assert R.can_process(R.source_tree(spark, str(tmp_path))).count() == 2


def test_logs(spark, tmp_path):
    (tmp_path / "1.log").write_text('{"timestamp":"t1","message":"m"}\nbroken {\n{"timestamp":"t2","message":"n"}\n')
    assert sorted(r.timestamp for r in R.json_lines(spark, str(tmp_path / "1.log")).collect()) == ["t1", "t2"]
    (tmp_path / "b.log").write_text('{"timestamp":"a",\n"message":"x"}\n\n{"timestamp":"b"}\n')
    assert sorted(r.timestamp for r in R.json_blocks(spark, str(tmp_path / "b.log")).collect()) == ["a", "b"]
    assert [r.text for r in R.tail(spark, str(tmp_path / "1.log"), 2).collect()][-1].startswith('{"timestamp":"t2"')


def test_latest_and_newest(spark, tmp_path):
    for i, name in enumerate(("a.log", "c.log", "b.log")):
        (tmp_path / name).write_text(f'junk\n{{"timestamp":"{name}"}}\n')
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert [p.rsplit("/", 1)[1] for p in R.latest_files(spark, str(tmp_path), 2)] == ["c.log", "b.log"]
    assert [r.timestamp for r in R.newest_entries(spark, str(tmp_path)).collect()] == ["b.log"]


def test_glossary_and_probes(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"terms": [{"term": "KUNDE", "translation": "customer"}]}))
    g = R.glossary(spark, str(tmp_path / "g.json"))
    assert [tuple(r) for r in g.collect()] == [("KUNDE", "customer")] and R.has_column(g, "term") and not R.has_table(spark, "no_such_table")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x")], "a int, b string")
    R.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = [r.value for r in R.markdown_table(df, ["a"]).collect()]
    assert lines[0] == "| a | b |" and lines[2] == "| 1 | x |"
    R.write_report(R.markdown_table(df, ["a"]), str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).count() == 4


def drained(q):
    q.processAllAvailable()
    q.stop()


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("one\ntwo\n")
    (tmp_path / "in/a.txt").write_text("no\n")
    q = L.log_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    drained(q)
    assert sorted(r.value for r in spark.table("lines").collect()) == ["one", "two"]


def calls(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t + dt.timedelta(seconds=s), 5) for s in (0, 10, 61, 130)], "agent string, ts timestamp, tokens long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_sliding_usage_stream(spark, tmp_path):
    s = L.admitted(L.sliding_usage(calls(spark, tmp_path), "60 seconds", "60 seconds"), 8, 5)
    q = s.writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "c")).start()
    drained(q)
    assert sorted((r.tokens, r.admit) for r in spark.table("usage").collect()) == [(5, True), (5, True), (10, False)]


def test_anchored_minute_stream(spark, tmp_path):
    q = L.minute_counts_stream(calls(spark, tmp_path)).writeStream.outputMode("update").format("memory").queryName("minutes").option("checkpointLocation", str(tmp_path / "c")).start()
    drained(q)
    assert [tuple(r) for r in spark.table("minutes").collect()] == [("a", 1)]


def test_live_status(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text('{"run_id": 1, "status": "Completed"}\n')
    stream = spark.readStream.schema("run_id long, status string").json(str(tmp_path / "in"))
    runs = spark.createDataFrame([(1, "Running")], "id long, status string")
    q = L.live_status(stream, runs).select(F.col("run_status")).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    drained(q)
    assert [r[0] for r in spark.table("live").collect()] == ["Running"]


# ---- large logs ----


def test_json_blocks_across_records(spark, tmp_path):
    objects = [{"timestamp": f"t{i}", "message": "m" * (i % 7), "data": "x"} for i in range(60)]
    rng = random.Random(1)
    text = ""
    for i, o in enumerate(objects):
        body = json.dumps(o) if i % 3 else json.dumps(o).replace(", ", ",\n\n  ", 1)  # an empty line inside an object
        text += body + rng.choice(["\n\n", "\n \n", "\n\n\n\n", "\n\t\n\n"])
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text('\n\n{"timestamp":"only"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert spark.read.option("lineSep", "\n\n").text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = sorted(r.timestamp for r in R.json_blocks(spark, str(tmp_path)).collect())
        assert [(r.line, r.text) for r in R.tail(spark, str(tmp_path / "a.log"), 4).collect()] == list(enumerate(text.removesuffix("\n").split("\n"), 1))[-4:]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([o["timestamp"] for o in objects] + ["only"])


def test_values_carried_over_blocks(spark):
    df = spark.createDataFrame([(n, n if n in (3, 4, 17) else None) for n in range(1, 31)], "n long, v long")
    assert [r.v for r in carried(df, "v", block=5).orderBy("n").collect()] == [None, None, 3, *[4] * 13, *[17] * 14]


def test_text_report_in_parts(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("line "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("value"))
    at = str(tmp_path / "r")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        R.write_report(df.repartition(7).orderBy("value"), at, "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(p for p in os.listdir(at) if p.startswith("part-"))
    text = "".join(open(f"{at}/{p}").read() for p in parts)
    assert len(parts) > 1 and text.splitlines() == [f"line {i:06}" for i in range(5000)]
    index = R.read_index(spark, at).orderBy("part").collect()
    assert [(r.part, text[r.offset :].split("\n", 1)[0]) for r in index] == [(r.part, f"line {r.first_line - 1:06}") for r in index]
    assert [tuple(r) for r in R.report_lines(spark, at, 1200, 1300).orderBy("line").collect()] == [(n, f"line {n - 1:06}") for n in range(1200, 1301)]


# ---- rates ----


def requests(seed, n=120, agents="ab", span=900):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    times = [rng.choice([rng.randrange(span), 60 * rng.randrange(span // 60)]) for _ in range(n)]
    return [(rng.choice(agents), i, t0 + dt.timedelta(seconds=s), rng.randrange(1, 30)) for i, s in enumerate(times)]


def admitted_one_by_one(rows, tokens, most, seconds=60):
    out, used = {}, {}
    for agent, i, ts, n in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = [u for u in used.get(agent, []) if (ts - u[0]).total_seconds() <= seconds]
        why = "TPM" if sum(u[1] for u in own) + n > tokens else "RPM" if len(own) + 1 > most else "OK"
        left = ((own[0][0] if own else ts) - ts).total_seconds() + seconds
        out[i] = (why == "OK", 0 if why == "OK" else int(left * 1000), why)
        used[agent] = [*own, (ts, n)]
    return out


def test_admissions_like_a_loop(spark):
    rows = requests(3)
    df = spark.createDataFrame(rows, "agent string, id long, ts timestamp_ntz, tokens long")
    got = {r.id: (r.admit, r.wait_ms, r.reason) for r in L.admissions(df, 60, 4).collect()}
    assert got == admitted_one_by_one(rows, 60, 4) and {x[2] for x in got.values()} == {"OK", "TPM", "RPM"}
    alone = L.admissions(df.limit(1).withColumn("tokens", F.lit(99).cast("bigint")), 60, 4).first()
    assert (alone.admit, alone.wait_ms, alone.reason) == (False, 60_000, "TPM")


def test_admissions_of_one_time_like_the_sql(spark):
    rows = requests(4)
    got = {r.id: (r.admit, r.wait_ms, r.reason) for r in L.admissions(spark.createDataFrame(rows, "agent string, id long, ts timestamp_ntz, tokens long"), 60, 4, peers=True).collect()}
    want = {}
    for agent, i, ts, n in rows:
        used = [(t, k) for a, j, t, k in rows if a == agent and j != i and 0 <= (ts - t).total_seconds() <= 60]
        why = "TPM" if sum(k for _, k in used) + n > 60 else "RPM" if len(used) + 1 > 4 else "OK"
        left = (min((t for t, _ in used), default=ts) - ts).total_seconds() + 60
        want[i] = (why == "OK", 0 if why == "OK" else int(left * 1000), why)
    assert got == want


def test_no_frame_of_admissions_is_scanned_again(spark):
    df = L.admissions(spark.createDataFrame(requests(3), "agent string, id long, ts timestamp_ntz, tokens long"), 60, 4)
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+), ([^)]+\)?)\)", df._jdf.queryExecution().analyzed().toString())
    assert frames and {start for _, start, _ in frames} == {"unboundedpreceding$()"}


@pytest.mark.parametrize("seed,seconds", [(1, 60), (2, 7), (3, 400)])
def test_anchored_minutes_like_a_loop(spark, seed, seconds):
    rows = requests(seed)
    want, state = {}, {}
    for agent, i, ts, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        start, n = state.get(agent, (None, 0))
        if start is None or (ts - start).total_seconds() >= seconds:
            start, n = ts, 0
        state[agent] = start, n + 1
        want[i] = n + 1
    df = spark.createDataFrame(rows, "agent string, id long, ts timestamp_ntz, tokens long")
    assert {r.id: r.used for r in L.minute_counts(df, seconds).collect()} == want


def test_admissions_stream_like_batch(spark, tmp_path):
    rows = requests(5, 80, span=400)
    kind = "agent string, id long, ts timestamp, tokens long"
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=random.Random(r[1]).randrange(100)))  # out of order by up to 100 s
    closing = [(a, -1, dt.datetime(2024, 1, 2), 1) for a in "ab"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate([shuffled[:30], shuffled[30:55], shuffled[55:], closing]):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = L.admissions_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 60, 4).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
            drained(q)  # and started again from its checkpoint for the next part
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).where("id >= 0").collect()
    assert len(got) == len(rows) and {r.id: (r.admit, r.wait_ms, r.reason) for r in got} == admitted_one_by_one(rows, 60, 4)


# ---- live status ----


def test_status_survives_a_failure_between_write_and_commit(spark, tmp_path, monkeypatch):
    kind = "run_id long, source_file string, chunk_index long, status string, ts long"
    at, c = str(tmp_path / "store"), str(tmp_path / "c")

    def arrive(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    stream = lambda: spark.readStream.schema(kind).json(str(tmp_path / "in"))
    arrive([(1, "a", 0, "Pending", 1), (1, "a", 1, "Pending", 1), (1, "a", 0, "Processing", 2)])
    drained(live.keep_status(stream(), at, c))
    arrive([(1, "a", 0, "Completed", 5), (2, "b", 0, "Failed", 3)])
    written = live.apply_updates

    def dies(rows, batch, to):
        written(rows, batch, to)
        raise RuntimeError("after the write, before the commit")

    monkeypatch.setattr(live, "apply_updates", dies)
    q = live.keep_status(stream(), at, c)
    with pytest.raises(Exception, match="before the commit"):
        q.processAllAvailable()
    q.stop()
    monkeypatch.setattr(live, "apply_updates", written)
    arrive([(1, "a", 0, "Processing", 4)])  # late, so not the last
    drained(live.keep_status(stream(), at, c))
    want = [(1, "a", 0, "Completed", 5), (1, "a", 1, "Pending", 1), (2, "b", 0, "Failed", 3)]
    assert sorted(tuple(r) for r in live.current_status(spark, at).collect()) == want
    assert sorted(tuple(r) for r in live.status_counts(live.current_status(spark, at)).collect()) == [(1, 1, 0, 1, 0), (2, 0, 0, 0, 1)]
    live.compacted(spark, at, str(tmp_path / "new"))
    assert sorted(tuple(r) for r in live.current_status(spark, str(tmp_path / "new")).collect()) == want


def test_combined_log_is_rebuilt(spark, tmp_path):
    (tmp_path / "in").mkdir()
    to, c = str(tmp_path / "log"), str(tmp_path / "c")
    (tmp_path / "in/a.log").write_text('{"timestamp":"3","category":"X","message":"c"}\n{"timestamp":"1","message":"a"}\n')
    drained(live.keep_log(spark, str(tmp_path / "in"), to, c))
    (tmp_path / "in/b.log").write_text('{"timestamp":"2","category":"Y","message":"b"}\n')
    drained(live.keep_log(spark, str(tmp_path / "in"), to, c))
    assert [r.value for r in R.report_lines(spark, f"{to}/version=1", 1, 9).orderBy("line").collect()] == ["1 [] a", "2 [Y] b", "3 [X] c"]
    assert len(os.listdir(to)) == 2
