"""Structured Streaming over logs and call records.

Watermarks and the treatment of late rows are this library's own additions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codequarry.staging import numbered, stored


def log_stream(spark: SparkSession, at: str) -> DataFrame:
    """Lines of *.log files as they appear in a folder."""
    return spark.readStream.option("pathGlobFilter", "*.log").text(at)


def sliding_usage(calls: DataFrame, window: str = "60 seconds", slide: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """Tokens and requests of (ts, tokens) in sliding windows; rows later than ``late`` are left out."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tokens", "requests")


def admitted(usage: DataFrame, tokens_per_minute: int, requests_per_minute: int) -> DataFrame:
    """Whether a window leaves room for another request."""
    return usage.withColumn("admit", (F.col("tokens") < tokens_per_minute) & (F.col("requests") < requests_per_minute))


def _micros(column: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def minute_counts(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """(agent, id, ts, used): requests in a minute that starts with the first one after the last minute's end.

    A minute is anchored at use: its first call is the agent's first one at least
    ``seconds`` after the first call of the minute before. Each call's successor in this
    sense is found among the calls of the next stretch of that length, or is the first
    one of the next stretch that has any. The anchors are the calls that the agent's
    first call leads to; they are marked by doubling the successors, so in a number of
    joins that grows with the logarithm of the minutes, and no agent's calls come into
    one task. Calls count in order of ts, then id.
    """
    span = seconds * 1_000_000
    rows = numbered(calls.select("agent", "id", "ts"), "agent", "ts", "id").withColumn("at", _micros())
    rows = stored(rows.withColumn("stretch", F.floor(F.col("at") / span)))
    # the first call of each stretch, and those of the next two stretches that have calls: one row a stretch
    by = Window.partitionBy("agent").orderBy("stretch")
    firsts = rows.groupBy("agent", "stretch").agg(F.min("n").alias("first"))
    firsts = firsts.select("agent", "stretch", F.lead("stretch").over(by).alias("next"), F.lead("first").over(by).alias("first_1"), F.lead("first", 2).over(by).alias("first_2"))
    asks = rows.select("agent", (F.col("stretch") + 1).alias("stretch"), (F.col("at") + span).alias("at"), F.lit(0).alias("call"), "n")
    both = rows.select("agent", "stretch", "at", F.lit(1).alias("call"), "n").union(asks)
    after = Window.partitionBy("agent", "stretch").orderBy("at", "call", "n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = both.select("agent", (F.col("stretch") - 1).alias("stretch"), "call", "n", F.min(F.when(F.col("call") == 1, F.col("n"))).over(after).alias("to")).where("call = 0")
    beyond = F.when(F.col("next") == F.col("stretch") + 1, F.col("first_2")).otherwise(F.col("first_1"))
    jump = stored(found.join(firsts, ["agent", "stretch"]).select("n", F.coalesce("to", beyond).alias("to")).where("to is not null"))
    anchors = stored(rows.groupBy("agent").agg(F.min("n").alias("n")).select("n"))
    while not jump.isEmpty():
        new = stored(anchors.join(jump, "n").select(F.col("to").alias("n")).union(anchors).distinct())
        jump = stored(jump.join(jump.select(F.col("n").alias("to"), F.col("to").alias("far")), "to").select("n", F.col("far").alias("to")))
        anchors = new
    # at most one in each stretch
    marked = rows.join(anchors, "n").select("agent", "stretch", F.col("n").alias("anchor"))
    earlier = marked.select("agent", (F.col("stretch") + 1).alias("stretch"), F.col("anchor").alias("earlier"))
    out = rows.join(marked, ["agent", "stretch"], "left").join(earlier, ["agent", "stretch"], "left")
    start = F.when(F.col("anchor") <= F.col("n"), F.col("anchor")).otherwise(F.col("earlier"))
    return out.select("agent", "id", "ts", (F.col("n") - start + 1).cast("int").alias("used"))


def _decided(n_tokens, n_requests, oldest, now, tokens, most_tokens: int, most_requests: int, span: int) -> list:
    """admit, wait_ms and reason of a request at ``now`` with what was used in the ``span`` before it."""
    over_tokens, over_requests = n_tokens + tokens > most_tokens, n_requests + 1 > most_requests
    left = F.coalesce(oldest, now) + span - now
    wait = F.when(over_tokens | over_requests, F.floor(F.when(left < 0, 1_000_000).otherwise(left) / 1000)).otherwise(0)
    return [(~(over_tokens | over_requests)).alias("admit"), wait.cast("bigint").alias("wait_ms"), F.when(over_tokens, "TPM").when(over_requests, "RPM").otherwise("OK").alias("reason")]


def admissions(calls: DataFrame, tokens_per_minute: int, requests_per_minute: int, seconds: int = 60, peers: bool = False) -> DataFrame:
    """(id, admit, wait_ms, reason) of each call (agent, id, ts, tokens) as a request, after the agent's calls of the ``seconds`` before it.

    Refused for tokens (TPM) before requests (RPM), it waits until the oldest of those
    calls is ``seconds`` old; without any, that long. Calls of one time count in order of
    id; with ``peers`` all the others of a call's time count. They are windowed by agent
    and stretch, with the stretch before beside it. What was used is what came so far
    less what is too old, so that every frame only grows and the work on n calls of a
    stretch grows with n.
    """
    span = seconds * 1_000_000
    rows = calls.select("agent", "id", "tokens", _micros().alias("at")).withColumn("stretch", F.floor(F.col("at") / span))
    both = rows.withColumn("own", F.lit(True)).unionByName(rows.withColumn("stretch", F.col("stretch") + 1).withColumn("own", F.lit(False)))
    none = F.lit(0).cast("bigint")
    both = both.withColumn("used", F.coalesce("tokens", none))
    by = Window.partitionBy("agent", "stretch")
    old = by.orderBy("at").rangeBetween(Window.unboundedPreceding, -span - 1)
    since = by.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, span)  # in falling order: all from ``span`` before it on
    total = lambda w: F.coalesce(F.sum("used").over(w), none)
    if peers:
        so_far = by.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        n, t = F.count("*").over(so_far) - 1, total(so_far) - F.col("used")
    else:
        so_far = by.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
        n, t = F.count("*").over(so_far), total(so_far)
    both = both.select("own", "id", "at", "used", n.alias("n"), t.alias("t"), F.count("*").over(old).alias("n_old"), total(old).alias("t_old"), F.min("at").over(since).alias("oldest"))
    n, t = F.col("n") - F.col("n_old"), F.col("t") - F.col("t_old")
    return both.where("own").select("id", *_decided(t, n, F.when(n > 0, F.col("oldest")), F.col("at"), F.col("used"), tokens_per_minute, requests_per_minute, span))


class _Admission(StatefulProcessor):
    """Requests of one agent: those that wait for the watermark, and the calls of the last minute."""

    def __init__(self, tokens: int, requests: int, seconds: int) -> None:
        self.tokens, self.requests, self.span = tokens, requests, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, tokens bigint")
        self.used = handle.getListState("used", "at bigint, tokens bigint")

    def handleInputRows(self, key, rows, timerValues):
        """New requests wait, until no earlier one can come."""
        new = [(pd.Timestamp(t).value // 1000, int(i), int(n)) for pdf in rows for t, i, n in zip(pdf["ts"], pdf["id"], pdf["tokens"])]
        yield from self._decide(key, [*map(tuple, self.waiting.get()), *new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._decide(key, list(map(tuple, self.waiting.get())), timerValues)

    def _decide(self, key, waiting: list, timers):
        ready = timers.getCurrentWatermarkInMs() * 1000
        used, out = list(map(tuple, self.used.get())), []
        for at, i, tokens in sorted(w for w in waiting if w[0] < ready):
            used = [u for u in used if u[0] >= at - self.span]
            over = "TPM" if sum(u[1] for u in used) + tokens > self.tokens else "RPM" if len(used) + 1 > self.requests else "OK"
            left = (used[0][0] if used else at) + self.span - at
            out.append((key[0], i, over == "OK", (1_000_000 if left < 0 else left) // 1000 if over != "OK" else 0, over))
            used.append((at, tokens))
        later = [w for w in waiting if w[0] >= ready]
        for state, rows in ((self.waiting, later), (self.used, used)):
            state.clear()
            if rows:
                state.put(rows)
        if later:
            self.handle.registerTimer(min(w[0] for w in later) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["agent", "id", "admit", "wait_ms", "reason"])

    def close(self) -> None:
        pass


def admissions_stream(calls: DataFrame, tokens_per_minute: int, requests_per_minute: int, seconds: int = 60, late: str = "2 minutes") -> DataFrame:
    """The same over a stream of (agent, id, ts, tokens): (agent, id, admit, wait_ms, reason), each given once the watermark has passed it.

    Rows may come in any order within ``late``; later ones are left out. An agent's
    state is what waits for the watermark, and its last ``seconds``; timers by event
    time let it go on. The session needs the RocksDB state store.
    """
    rows = calls.withWatermark("ts", late).groupBy("agent")
    schema = "agent string, id bigint, admit boolean, wait_ms bigint, reason string"
    return rows.transformWithStateInPandas(_Admission(tokens_per_minute, requests_per_minute, seconds), schema, "Append", "EventTime")


def trailing_usage(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """(id, tokens, requests): of each call and those of its agent in the ``seconds`` before it.

    Calls are windowed by agent and stretch of that length, with those of the
    stretch before beside them, so that no agent's calls come into one task.
    """
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    span = seconds * 1_000_000
    rows = calls.select("agent", "id", "tokens", micros.alias("at")).withColumn("stretch", F.floor(F.col("at") / span))
    both = rows.withColumn("own", F.lit(True)).unionByName(rows.withColumn("stretch", F.col("stretch") + 1).withColumn("own", F.lit(False)))
    w = Window.partitionBy("agent", "stretch").orderBy("at").rangeBetween(-span, 0)
    return both.select("id", "own", F.sum("tokens").over(w).alias("tokens"), F.count("*").over(w).alias("requests")).where("own").drop("own")


def within(events: DataFrame, runs: DataFrame, margin: int, hours: int = 1) -> DataFrame:
    """(id, ts, run) of events (id, ts) within ``margin`` seconds of a run's span (run, s, e); a run without end goes on to the last event.

    Both meet in buckets of ``hours``. A run without end holds every later event, as
    asked for, so rows grow with open runs times events; ``within`` gives them, a caller
    that only needs numbers counts by run.
    """
    length = hours * 3600
    number = lambda t: F.floor(F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {t})") / length)
    last = events.agg(F.max("ts").alias("t")).first().t
    r = runs.withColumn("a", F.col("s") - F.expr(f"interval {margin} seconds")).withColumn("b", F.coalesce(F.col("e") + F.expr(f"interval {margin} seconds"), F.lit(last).cast("timestamp_ntz")))
    r = r.where("a <= b").select("run", "a", "b", F.explode(F.sequence(number("a"), number("b"))).alias("bucket"))
    t = events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("bucket", number("ts"))
    return t.join(r, "bucket").where("ts between a and b").select("id", "ts", "run")


def minute_counts_stream(calls: DataFrame) -> DataFrame:
    """The same over a stream of (agent, ts): the anchor and count of each agent are kept as state."""

    def run(key: tuple, batches, state: GroupState):
        start, used = state.get if state.exists else (0.0, 0)
        for pdf in batches:
            for ts in pdf["ts"].sort_values():
                t = ts.timestamp()
                if not used or t - start >= 60:
                    start, used = t, 0
                used += 1
        state.update((start, used))
        yield pd.DataFrame({"agent": [key[0]], "used": [used]})

    return calls.groupBy("agent").applyInPandasWithState(run, "agent string, used long", "start double, used long", "update", GroupStateTimeout.NoTimeout)


def live_status(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks (a stream) with the state of their run (a table)."""
    return chunks.join(runs.select(F.col("id").alias("run_id"), F.col("status").alias("run_status")), "run_id", "left")
