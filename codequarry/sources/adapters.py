"""The model's tables as views over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _status():
    return F.when(F.col("event_type") == "purchase", "Completed").when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "click", "Processing").otherwise("Pending")


def _file_name():
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.when(F.col("lang") != "en", ".cpy").otherwise(".cbl"))


class Model:
    """Lazy DataFrames of one scale's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def runs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed")
        out = F.when(F.col("o_orderkey") % 3 == 0, "java-out").when(F.col("o_orderkey") % 3 == 1, "CSharp/out").otherwise("output")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 2 hours")).alias("completed_at"), status.alias("status"), out.alias("java_output"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("run "), F.col("o_orderkey").cast("string"), F.lit(" done"))).alias("notes"))

    @property
    def files(self) -> DataFrame:
        copy, name = F.col("lang") != "en", _file_name()
        return self.table("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("run_id"), name.alias("file_name"), F.concat(F.lit("src/"), F.col("source"), F.lit("/"), name).alias("file_path"), copy.alias("is_copybook"), F.col("text").alias("content"))

    @property
    def analyses(self) -> DataFrame:
        return self.table("documents").where("doc_id % 3 <> 0").select((F.col("doc_id") + 1000000).alias("id"), F.col("doc_id").alias("cobol_file_id"), F.col("source").alias("program_description"), F.col("text").alias("raw_analysis"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit('["'), F.col("lang"), F.lit('","'), F.col("source"), F.lit('"]'))).alias("paragraphs_json"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"name":"A"}'), (F.col("doc_id") % 4).cast("int")), ","), F.lit("]"))).alias("variables_json"))

    @property
    def chunks(self) -> DataFrame:
        from pyspark.sql import Window

        index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
        e = self.table("events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("chunk_index", index)
        return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), "chunk_index", (F.col("chunk_index") * 900 + 1).alias("start_line"), (F.col("chunk_index") * 900 + 1000).alias("end_line"), _status().alias("status"), F.floor("value").cast("bigint").alias("tokens_used"), F.floor(F.col("value") * 10).cast("bigint").alias("processing_time_ms"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("completed_at"))

    @property
    def described(self) -> DataFrame:
        """Chunks with the names of their units."""
        names = F.array(*[F.lit(f"UNIT-{k}") for k in range(1, 8)])
        return self.chunks.withColumn("units", F.slice(names, F.lit(1), (F.col("id") % 8).cast("int")))

    @property
    def extracts(self) -> DataFrame:
        """A file's stories, features and rules as JSON arrays."""
        part = lambda by: F.to_json(F.split("text", by))
        return self.table("documents").select((F.col("lang") != "en").alias("is_copybook"), part("\\. ").alias("stories_json"), part(", ").alias("features_json"), part("\n").alias("rules_json"))

    @property
    def deps(self) -> DataFrame:
        """Every event; each file depends on three others at most, so that trails stay few, and many of them close."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        target = F.expr("case k % 3 when 0 then user_id + 1 when 1 then user_id div 2 else user_id div 3 end")
        return self.table("events").withColumn("k", k).select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), F.concat(F.lit("f"), target.cast("string")).alias("target_file"), F.upper("event_type").alias("dependency_type"), (F.col("event_id") % 97).alias("line_number"))

    @property
    def links(self) -> DataFrame:
        """Every event as a dependency of its user's file on the file that its data names."""
        return self.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("target_file"), F.upper("event_type").alias("dependency_type"))

    @property
    def copies(self) -> DataFrame:
        """copybook_usage"""
        k = F.get_json_object("props", "$.k")
        return self.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("program"), F.concat(F.lit("c"), (k.cast("bigint") % 40).cast("string"), F.lit(".cpy")).alias("copybook"))

    @property
    def api(self) -> DataFrame:
        """api_calls"""
        return self.table("events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("agent"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("bigint").alias("tokens"), (F.floor("value").cast("bigint") * 3).alias("micros"))

    @property
    def sigs(self) -> DataFrame:
        """Registrations of signatures in order of seq; keys repeat."""
        return self.table("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), F.upper("event_type").alias("legacy_name"), F.concat(F.col("event_type"), (F.col("event_id") % 3).cast("string")).alias("method"), F.when(F.col("event_id") % 4 == 0, "void").when(F.col("event_id") % 4 == 1, "int").otherwise("String").alias("return_type"), (F.col("event_id") % 3).alias("n_params"), F.slice(F.array(F.when(F.col("event_id") % 5 == 0, "int").otherwise("String"), F.when(F.col("event_id") % 7 == 0, "int").otherwise("String")), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("params"))

    @property
    def refs(self) -> DataFrame:
        """forward_references"""
        return self.table("events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("source_file"), F.concat(F.col("event_type"), (F.col("event_id") % 4).cast("string")).alias("target_method"), (F.col("event_id") % 15 == 0).alias("resolved"), F.when(F.col("event_id") % 15 == 0, F.lit("known()")).alias("actual_signature"))

    @property
    def sources(self) -> DataFrame:
        """All documents as programs: some frequent words stand for statements, other than ASCII characters for x."""
        return self._programs(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))

    @property
    def callers(self) -> DataFrame:
        """As ``sources``, but calls name their program by the word that follows in the text."""
        text = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
        for word, call in CALLED:
            text = F.regexp_replace(text, f" {word} {CALLED_NAME}", call.format("$1"))
        return self._programs(text)

    def _programs(self, text) -> DataFrame:
        for word, statement in STATEMENTS:
            text = F.replace(text, F.lit(f" {word} "), F.lit(statement))
        return self.table("documents").select(_file_name().alias("file"), text.alias("content"))

    @property
    def replies(self) -> DataFrame:
        """All documents as Markdown replies: some frequent words stand for headings and list items."""
        text = F.col("text")
        for word, mark in MARKS:
            text = F.replace(text, F.lit(f" {word} "), F.lit(mark))
        return self.table("documents").select(F.col("doc_id").alias("id"), text.alias("text"))

    @property
    def spans(self) -> DataFrame:
        """Runs with their time span among the events; some have no end."""
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(o_orderkey * 37 % 43200 as int), 0)")
        return self.table("orders").select(F.col("o_orderkey").alias("run"), start.alias("s")).withColumn("e", F.when(F.col("run") % 1000 != 0, F.col("s") + F.expr("interval 30 minutes")))

    @property
    def chat(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", F.col("role").alias("agent"), F.col("text").alias("message"), F.floor(F.length("text") / 4).cast("bigint").alias("tokens"))


#: What stands for a frequent word of the documents' languages in ``sources``.
STATEMENTS = (
    ("the", "\n       COPY "), ("and", "\n           CALL PROG-A USING "), ("of", "\n           PERFORM "), ("is", "\n           READ "), ("was", "\n       01  WS-REC.\n           05  WS-QTY PIC S9(4)\n               COMP-3 VALUE 0.\n           05  WS-TAB OCCURS 1 TO 9 TIMES DEPENDING ON WS-QTY\n               PIC X(3). 05 WS-R REDEFINES WS-TAB PIC X(27) VALUE 'A. B'.\n       "),
    ("in", "\n           EXEC SQL SELECT A FROM "), ("to", " END-EXEC\n           "), ("it", "\n       PROCEDURE DIVISION.\n       "), ("that", "\n       MAIN-PARA.\n           GO TO "), ("on", "\n           EXEC CICS LINK PROGRAM('ABC') END-EXEC\n"),
    ("de", "\n           PERFORM "), ("la", "\n       COPY "), ("que", "\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       "), ("der", "\n       COPY "), ("die", "\n           CALL 'sub_1' "), ("und", "' END-EXEC\n       LOOK-UP SECTION.\n       "), ("en", "\n           OPEN INPUT "), ("et", "\n      *"),
)
#: What stands in ``callers`` for a frequent word with the name after it. Tabs keep the name from being taken for a statement.
CALLED = (("and", "\n           CALL\t{}\tUSING"), ("die", "\n           CALL\t'{}'"))
CALLED_NAME = "([A-Za-z][A-Za-z0-9_-]+)"
#: What stands for a frequent word in ``replies``.
MARKS = (
    ("the", "\n- "), ("of", "\n### Use Case: "), ("and", "\n**Description:** "), ("in", "\n**Key Steps:**\n2. "), ("is", "\n### Feature: "), ("to", "\n**Trigger:** "),
    ("that", "\n## Business Rules\n- "), ("was", "\nDescription: "), ("it", "\n\n## Other\n"), ("for", "\nBusiness Purpose\n"), ("de", "\n- "), ("la", "\n### User Story "),
    ("que", "\n**Key Steps:**\n1. "), ("der", "\n### Feature "), ("die", "\n## Validations\n- **"), ("und", "\n**Description:** "), ("en", "\n**Trigger:** "), ("el", "\n**Description:** "),
)
_quoted = lambda t: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n"))
_code = _calling = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"
for _word, _call in CALLED:
    _calling = f"regexp_replace({_calling}, ' {_word} {CALLED_NAME}', {_quoted(_call.format(chr(92) + '1'))}, 'g')"
for _word, _statement in STATEMENTS:
    _code, _calling = (f"replace({x}, ' {_word} ', {_quoted(_statement)})" for x in (_code, _calling))
_reply = "text"
for _word, _mark in MARKS:
    _reply = f"replace({_reply}, ' {_word} ', {_quoted(_mark)})"

#: The same views for DuckDB.
CTES = {
    "sources": f"select 'doc_' || doc_id || case when lang <> 'en' then '.cpy' else '.cbl' end file, {_code} as content from documents",
    "callers": f"select 'doc_' || doc_id || case when lang <> 'en' then '.cpy' else '.cbl' end file, {_calling} as content from documents",
    "replies": f"select doc_id id, {_reply} as text from documents",
    "spans": "select *, case when run % 1000 <> 0 then s + interval 30 minute end e from (select o_orderkey run, timestamp '2024-01-01' + to_minutes((o_orderkey * 37 % 43200)::bigint) s from orders)",
    "runs": "select o_orderkey id, o_orderdate started_at, case when o_orderstatus = 'F' then o_orderdate + interval 2 hour end completed_at, case o_orderstatus when 'O' then 'Running' when 'F' then 'Completed' else 'Failed' end status, case o_orderkey % 3 when 0 then 'java-out' when 1 then 'CSharp/out' else 'output' end java_output, case when o_orderkey % 7 <> 0 then 'run ' || o_orderkey || ' done' end notes from orders",
    "files": "select doc_id id, doc_id % 10 run_id, 'doc_' || doc_id || case when lang <> 'en' then '.cpy' else '.cbl' end file_name, 'src/' || source || '/doc_' || doc_id || case when lang <> 'en' then '.cpy' else '.cbl' end file_path, lang <> 'en' is_copybook, text as content from documents",
    "analyses": "select doc_id + 1000000 id, doc_id cobol_file_id, source program_description, text raw_analysis, case when doc_id % 4 <> 0 then '[\"' || lang || '\",\"' || source || '\"]' end paragraphs_json, case when doc_id % 5 <> 0 then '[' || rtrim(repeat('{\"name\":\"A\"},', (doc_id % 4)::int), ',') || ']' end variables_json from documents where doc_id % 3 <> 0",
    "chunks": "select event_id id, user_id % 10 run_id, 'f' || user_id source_file, chunk_index, chunk_index * 900 + 1 start_line, chunk_index * 900 + 1000 end_line, case event_type when 'purchase' then 'Completed' when 'error' then 'Failed' when 'click' then 'Processing' else 'Pending' end status, floor(value)::bigint tokens_used, floor(value * 10)::bigint processing_time_ms, case when event_type = 'purchase' then ts end completed_at from (select *, (row_number() over (partition by user_id order by event_id) - 1)::int chunk_index from events)",
    "extracts": "select lang <> 'en' is_copybook, to_json(string_split(text, '. ')) stories_json, to_json(string_split(text, ', ')) features_json, to_json(string_split(text, chr(10))) rules_json from documents",
    "deps": "select event_id id, user_id % 10 run_id, 'f' || user_id source_file, 'f' || (case (props ->> '$.k')::bigint % 3 when 0 then user_id + 1 when 1 then user_id // 2 else user_id // 3 end) target_file, upper(event_type) dependency_type, event_id % 97 line_number from events",
    "links": "select event_id id, user_id % 10 run_id, 'f' || user_id source_file, 'f' || (props ->> '$.k') target_file, upper(event_type) dependency_type from events",
    "copies": "select event_id id, user_id % 10 run_id, 'f' || user_id program, 'c' || ((props ->> '$.k')::bigint % 40) || '.cpy' copybook from events",
    "api": "select event_id id, ts, event_type agent, 'm' || (user_id % 3) model, floor(value * 10)::bigint duration_ms, event_type <> 'error' ok, floor(value)::bigint tokens, floor(value)::bigint * 3 micros from events",
    "sigs": "select event_id seq, user_id % 10 run_id, 'f' || user_id source_file, upper(event_type) legacy_name, event_type || (event_id % 3) as method, case event_id % 4 when 0 then 'void' when 1 then 'int' else 'String' end return_type, event_id % 3 n_params, [case when event_id % 5 = 0 then 'int' else 'String' end, case when event_id % 7 = 0 then 'int' else 'String' end][1:event_id % 3] params from events",
    "refs": "select event_id id, user_id % 10 run_id, 'f' || user_id source_file, event_type || (event_id % 4) target_method, event_id % 15 = 0 resolved, case when event_id % 15 = 0 then 'known()' end actual_signature from events",
    "chat": "select conv_id, turn, role agent, text message, floor(length(text) / 4)::bigint tokens from conversations",
}

CTES["described"] = f"select *, ['UNIT-1', 'UNIT-2', 'UNIT-3', 'UNIT-4', 'UNIT-5', 'UNIT-6', 'UNIT-7'][1:id % 8] units from ({CTES['chunks']})"


def with_views(sql: str) -> str:
    """``sql`` with the views that it names in front."""
    used = [f"{k} as ({v})" for k, v in CTES.items() if re.search(rf"\b(from|join)\s+{k}\b", sql)]
    body = sql.strip()
    recursive = body.startswith("with recursive ")
    if body.startswith("with "):
        body = ", " + body.removeprefix("with recursive ").removeprefix("with ") if used else body.removeprefix("with recursive ").removeprefix("with ")
    return f"with {'recursive ' * recursive}" + ", ".join(used) + " " + body if used or recursive else sql.strip()
