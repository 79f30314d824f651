"""Queries of the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.functions import scalars as S
from codequarry.plans.common import add, rules

#: Authored inputs of the rules.
NAMES = ["WS-CUSTOMER-ID", "LS-CLASS", "CUSTOMER_NAME", "FD-INT", "ACCT--NO", "X", "WK-9-LIVES", "SD-RETURN"]
PICS = ["pic s9(4) comp", "FIXED BIN(31)", "FLOAT(53)", "BIT(1)", "INTEGER*8", "integer*2", "INTEGER", "REAL*8", "REAL", "DOUBLE PRECISION", "LOGICAL", "CHARACTER*20", "POINTER", "PIC", "PIC 9(4)", "PIC S9(8)", "PICTURE IS 9(15)", "PIC 9(20)", "PIC S9(9)V99", "PIC X(50)", "PIC A(3)", "PIC 999", "COMP", "FIXED DEC(7,2)", "CHAR(8)", "PIC X", "PIC ZZ9.99", "BINARY"]
CODE = ["public class A {}\n  class B_2\nclass A", "// class X\ninternal sealed class Y1 : Z", "static abstract class Q", "none", ""]
REPORTS = ["### Embedded SQL\nSELECT 1\n### Other\nx", "### database\n a \n b ", "## Database\nno", "### DB2 Interaction: t\n\n### Embedded SQL", ""]
CUTS = ["int a; // ... rest", "// TODO: implement\n// todo add", "// Omitted here\nx ...", "a ... b", "done.", "// truncated\n...  "]
TEXTS = ["what does CUST-A.cbl do", "Explain PAY.cpy please", "see run 42 now", "status of RUN ID 7", "runs/15/graph", "nothing here", "grow 5 trees", "[12.30.05] start", "[01:02:03.456] go", "rest of code ...", "```cobol\nMOVE A TO B.\n```", "x ```\nplain\n``` y", "ends ...", "``` open"]
FILES = ["src/cust-inquiry.cbl", "9LIVES.cpy", ".cbl", "a/b/PAY_roll.run.cbl", "ORDERS"]
METHODS = ["MAINPROGRAM", "cobol", "9lives", "_ok", "a-b", "", "RecordSync", "OrderService", "CalculateTotals", "Run", "Step1ValidateAll", "paymentProcessor", "abc", "TotalValue"]


def _values(items):
    return "(values " + ", ".join("(" + str(i) + ", '" + x.replace("\\", "\\\\").replace("'", "''") + "')" for i, x in enumerate(items)) + ") v(i, x)" if not any("\n" in x for x in items) else "(values " + ", ".join("(" + str(i) + ", " + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in x.split("\n")) + ")" for i, x in enumerate(items)) + ") v(i, x)"


def _frame(m, items):
    return m.spark.createDataFrame(list(enumerate(items)), "i int, x string")


_docs = lambda m: m.files.select("id", "content")
_lines = "(length(content) - length(replace(content, chr(10), '')) + 1)"
add("f1_line_count", lambda m: _docs(m).select("id", S.line_count(F.col("content")).alias("lines")), f"select id, {_lines}::int as lines from files")
add("f2_token_estimates", lambda m: _docs(m).select("id", *[c.cast("bigint").alias(k) for k, c in S.token_estimates(F.col("content")).items()]), "select id, floor(length(content) / 4)::bigint \"chunk\", ceil(length(content) / 3.5)::bigint general, ceil(length(content) / 3.0)::bigint cobol, floor(length(content) / 4)::bigint chat from files")
add("f3_truncate", lambda m: _docs(m).select("id", F.md5(S.truncated(F.col("content"), F.lit(500)).cast("binary")).alias("h"), F.md5(S.truncated(F.col("content"), F.lit(500), True).cast("binary")).alias("t")), "with a as (select id, content c, substr(content, 1, 500) s, substr(content, length(content) - 499, 500) e from files), b as (select *, strpos(reverse(s), chr(10)) r, strpos(e, chr(10)) p from a) select id, md5(case when length(c) <= 500 then c when r > 0 and length(s) - r > 400 then substr(s, 1, length(s) - r) else s end) h, md5(case when length(c) <= 500 then c when p > 0 and p < 100 then substr(e, p + 1) else e end) t from b")
add("f4_head_and_tail", lambda m: _docs(m).select("id", F.md5(S.head_and_tail(F.col("content"), 10).cast("binary")).alias("h")), "with a as (select id, content, string_split(content, chr(10)) l from files) select id, md5(case when len(l) <= 10 then content else array_to_string(list_concat(l[1:4], ['... truncated ...'], l[len(l) - 4:]), chr(10)) end) h from a")
add("f5_request_delay", lambda m: m.api.where("tokens > 0").select("id", S.request_delay(F.lit(300000), F.col("tokens") * 100, 700).alias("delay")), "select id, least(greatest(trunc(60000.0::double / ((300000 * 0.5::double) / (tokens * 100)))::int, 700), 120000) delay from api where tokens > 0")
_cap = "list_transform(list_filter(regexp_split_to_array(lower({0}), '[{1}]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:])"
add("f6_case_styles", lambda m: _frame(m, NAMES).select("x", S.pascal(F.col("x")).alias("pascal"), S.camel(F.col("x")).alias("camel"), S.constant(F.col("x")).alias("const")), f"with p as (select x, array_to_string({_cap.format('x', '-')}, '') p from {_values(NAMES)}) select x, p pascal, lower(p[1]) || p[2:] camel, upper(array_to_string(list_filter(string_split(lower(x), '-'), lambda q: q <> ''), '_')) const from p")
_java = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_sharp = "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
_list = lambda t: ", ".join(f"'{w}'" for w in t.split())
add("f7_names", lambda m: _frame(m, NAMES).select("x", S.legacy_name(F.col("x")).alias("java"), S.legacy_name(F.col("x"), "parameter", "csharp").alias("csharp"), S.legacy_name(F.col("x"), "class", suffix="Dto").alias("class"), S.legacy_name(F.col("x"), "property", "csharp").alias("property"), S.legacy_name(F.col("x"), "constant").alias("const")), "with p as (select x, " + _cap.format("regexp_replace(upper(x), '^(WS|LS|WK|LK|FD|SD)-', '')", "_-") + " q from " + _values(NAMES) + "), c as (select x, array_to_string(q, '') p, lower(array_to_string(q, '')[1]) || array_to_string(q, '')[2:] c, upper(array_to_string(q, '_')) k from p) select x, case when lower(c) in (" + _list(_java) + ") then c || '_' else c end java, case when lower(c) in (" + _list(_sharp) + ") then '@' || c else c end csharp, p || 'Dto' as \"class\", case when lower(p) in (" + _list(_sharp) + ") then '@' || p else p end property, case when lower(k) in (" + _list(_java) + ") then k || '_' else k end const from c")
add("f8_name_validity", lambda m: _frame(m, METHODS).select("x", *[F.col("x").rlike(p).alias(k) for k, p in S.NAME_PATTERNS.items()]), "select x, " + ", ".join(f"regexp_matches(x, '{p}') \"{k}\"" for k, p in S.NAME_PATTERNS.items()) + f" from {_values(METHODS)}")
add("f9_class_name", lambda m: _frame(m, FILES).select("x", S.class_name(F.col("x")).alias("name")), "with s as (select x, regexp_replace(regexp_replace(x, '^.*/', ''), '\\.[^.]*$', '') s from " + _values(FILES) + "), p as (select x, array_to_string(" + _cap.format("regexp_replace(s, '[^A-Za-z0-9]+', '-', 'g')", "-") + ", '') p from s) select x, case when p = '' then 'ConvertedCobolProgram' when regexp_matches(p, '^[0-9]') then 'Cobol' || p else p end as name from p")
add("f10_semantic_name", lambda m: _frame(m, METHODS).select("x", S.semantic_name(F.col("x")).alias("ok"), S.valid_identifier(F.col("x")).alias("valid")), f"select x, lower(x) not in ('convertedcobolprogram', 'cobolprogram', 'program', 'mainprogram', 'cobolconverter', 'convertedprogram', 'legacyprogram', 'migratedprogram', 'application', 'main', 'entry', 'cobol') and x <> '' and (regexp_matches(x, '(Service|Processor|Handler|Validator|Calculator|Generator|Manager|Controller|Repository|Factory|Builder|Worker|Job|Task|Runner|Executor|Parser|Formatter|Converter|Transformer|Mapper|Reader|Writer|Loader|Exporter|Importer|Scheduler|Dispatcher|Notifier|Reporter|Analyzer|Sanitizer|Reconciler|Aggregator|Batcher|Sync)$') or (len(regexp_extract_all(x, '[A-Z]')) >= 2 and length(x) >= 10 and not regexp_matches(x, '[0-9]'))) ok, regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') valid from {_values(METHODS)}")
add("f11_class_names", lambda m: _frame(m, CODE).select("i", F.array_join(S.class_declarations(F.col("x")), ",").alias("names")), f"select i, array_to_string(regexp_extract_all(x, '(?m)^\\s*(?:public|protected|private|internal)?\\s*(?:static)?\\s*(?:sealed|abstract|partial)?\\s*class\\s+([a-zA-Z0-9_]+)', 1)[:2], ',') as \"names\" from {_values(CODE)}")
add("f12_clock", lambda m: _frame(m, TEXTS).select("i", S.clock(F.col("x")).alias("clock")), f"select i, nullif(replace(regexp_extract(x, '\\[(\\d\\d[:.]\\d\\d[:.]\\d\\d)(?:\\.\\d+)?\\]', 1), '.', ':'), '') clock from {_values(TEXTS)}")
add("f13_log_level", lambda m: m.api.select("id", F.when(F.upper("agent").contains("ERROR"), "error").otherwise("info").alias("level")), "select id, case when contains(upper(agent), 'ERROR') then 'error' else 'info' end as level from api")
add("f14_run_id", lambda m: _frame(m, TEXTS).select("i", S.run_id_of(F.col("x")).alias("run")), f"select i, try_cast(coalesce(nullif(regexp_extract(x, '(?i)\\brun\\s*(?:id\\s*)?(\\d+)\\b', 1), ''), nullif(regexp_extract(x, 'runs/(\\d+)/', 1), '')) as bigint) run from {_values(TEXTS)}")
add("f15_asked_file", lambda m: _frame(m, TEXTS).select("i", S.asked_file(F.col("x")).alias("file")), f"select i, coalesce(nullif(regexp_extract(x, '(?i)(?:what does|explain|describe)\\s+([A-Z0-9_-]+\\.(?:cbl|cpy))', 1), ''), nullif(regexp_extract(x, '(?i)([A-Z0-9_-]+\\.(?:cbl|cpy))', 1), '')) file from {_values(TEXTS)}")
add("f16_sections", lambda m: _frame(m, REPORTS).select("i", F.explode(S.database_sections(F.col("x"))).alias("part")), f"with b as (select i, unnest(string_split(chr(10) || x, chr(10) || '###')) p from {_values(REPORTS)}) select i, regexp_replace(regexp_extract(p, '(?is)^\\s*(?:Embedded SQL|DB2 Interaction|Database)(.*)$', 1), '^\\s+|\\s+$', '', 'g') part from b where regexp_matches(p, '(?i)^\\s*(Embedded SQL|DB2 Interaction|Database)')")
add("f17_json_lists", lambda m: m.analyses.select("id", F.to_json(F.from_json("paragraphs_json", "array<string>")).alias("again")), "select id, paragraphs_json again from analyses")
_p = "upper(trim(regexp_replace(upper(x), '^(PICTURE|PIC)\\s+(IS\\s+)?', '')))"
_n9 = "(coalesce(list_sum(list_transform(regexp_extract_all({0}, '9\\((\\d+)\\)', 1), lambda y: y::int)), 0) + length(regexp_replace(regexp_replace({0}, '9\\(\\d+\\)', '', 'g'), '[^9]', '', 'g')))"
_t18 = "case when starts_with(t, 'PIC') then case when regexp_matches(p, '[V.]') and " + _n9.format("f") + " > 0 then '{1}' when contains(p, '9') and not regexp_matches(p, '[XA]') then case when n <= 4 then 'short' when n <= 9 then 'int' when n <= 18 then 'long' else '{1}' end when regexp_matches(p, '[XA]') then '{0}' when regexp_matches(t, 'COMP|BINARY') then 'int' else '{0}' end when regexp_matches(t, 'FIXED|FLOAT|CHAR|BIT') then case when contains(t, 'FIXED') and contains(t, 'BIN') then 'int' when contains(t, 'FIXED') and contains(t, 'DEC') then '{1}' when contains(t, 'FLOAT') then 'double' when contains(t, 'CHAR') then '{0}' when contains(t, 'BIT') then '{2}' else '{0}' end when starts_with(t, 'INTEGER') then case when regexp_matches(t, '[*]8|[(]8[)]') then 'long' when regexp_matches(t, '[*]2|[(]2[)]') then 'short' else 'int' end when starts_with(t, 'REAL') then case when regexp_matches(t, '[*]8|[(]8[)]') then 'double' else 'float' end when starts_with(t, 'DOUBLE') then 'double' when starts_with(t, 'LOGICAL') then '{2}' else '{0}' end"
add("f18_pic_types", lambda m: _frame(m, PICS).select("x", S.target_type(F.col("x")).alias("java"), S.target_type(F.col("x"), "csharp").alias("csharp"), S.digits(F.upper("x")).cast("bigint").alias("digits")), f"with a as (select x, upper(trim(x)) t, trim(replace(replace(upper(x), 'PIC', ''), 'PICTURE', '')) p from {_values(PICS)}), b as (select *, regexp_extract(p, '([^V.]*)$', 1) f, {_n9.format('p')} n, {_n9.format('t')} d from a) select x, {_t18.format('String', 'BigDecimal', 'boolean')} java, {_t18.format('string', 'decimal', 'bool')} csharp, d::bigint digits from b")
_signs = "EXEC\\s+SQL:3 EXEC\\s+CICS:4 EXEC\\s+DLI:4 PERFORM\\s+VARYING:2 PERFORM\\s+UNTIL:1 EVALUATE\\s+TRUE:2 SEARCH\\s+ALL:2 REDEFINES:2 OCCURS\\s+\\d+.*DEPENDING:3 OCCURS\\s+\\d+:1 COMPUTE\\b:1 INSPECT\\b:1 STRING\\b:1 UNSTRING\\b:2 CALL\\s+''[^'']+'':2 ALTER\\b:3 GO\\s+TO\\s+DEPENDING:3 COPY\\b:1 REPLACE\\b:2"
_noise = "'(?i)^\\s*$|^.{{6}}[*]|^.{{0,5}}[*]>|^.{{7}}\\s*(CBL|PROCESS|EJECT|SKIP1|SKIP2|SKIP3)\\b'".replace("{{", "{").replace("}}", "}")
_full = f"greatest(len(list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, {_noise}))), 1)"
_score = " + ".join("len(regexp_extract_all(content, '(?i)" + x.rsplit(":", 1)[0] + "')) * " + x.rsplit(":", 1)[1] for x in _signs.split(" "))
_score += f" + case when len(regexp_extract_all(content, '(?i)\\bPIC\\b'))::double / {_full} > 0.25 then 3 else 0 end + case when len(regexp_extract_all(content, '(?m)^\\s*\\d{{2}}\\s+'))::double / {_full} > 0.30 then 2 else 0 end"
_score += " + case when regexp_matches(content, '(?i)(WORKING-STORAGE|LINKAGE)\\s+SECTION[\\s\\S]{0,500}COPY\\b') then 3 else 0 end + case when regexp_matches(content, '(?i)EXEC\\s+(SQL|DLI)\\b') then 4 else 0 end"
add("f19_complexity", lambda m: m.sources.select("file", S.complexity(F.col("content"), rules(m).signs()).alias("score")), f"select file, (case when regexp_matches(content, '\\S') then {_score} else 0 end)::int score from sources")
add("f20_tier_and_budget", lambda m: m.api.select("id", S.tier(F.col("tokens") % 20).alias("tier"), S.token_budget(F.col("tokens") * 100, F.col("tokens") % 20).alias("budget")), "with a as (select id, tokens * 100 n, tokens % 20 c from api), b as (select *, trunc(n * (case when c >= 15 then 3.5 when c >= 5 then 2.5 else 1.5 end))::int need from a) select id, case when c >= 15 then 'High' when c >= 5 then 'Medium' else 'Low' end tier, least(greatest(need, case when c >= 5 or n >= 16384 then 32768 else greatest(4096, need) end), 100000) budget from b")
add("f21_fenced", lambda m: _frame(m, TEXTS).select("i", S.fenced(F.col("x")).alias("code")), f"with a as (select i, x, regexp_extract(x, '(?s)```cobol\\n(.*?)```', 1) a, regexp_extract(x, '(?s)```[a-z]*\\n(.*?)```', 1) b from {_values(TEXTS)}) select i, trim(case when a <> '' then a when b <> '' then b else x end) code from a")
add("f22_meaningful_lines", lambda m: m.sources.select("file", S.meaningful_lines(F.col("content")).alias("n")), f"select file, len(list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, {_noise})))::int n from sources")
add("f23_importance", lambda m: m.copies.groupBy("program").agg(F.countDistinct("copybook").alias("degree")).withColumn("rank", S.importance(F.col("degree"))), "select program, count(distinct copybook) degree, case when count(distinct copybook) > 5 then 'Critical' when count(distinct copybook) > 2 then 'Important' else 'Standard' end rank from copies group by 1")
add("f24_cut_off", lambda m: _frame(m, CUTS).select("i", S.cut_signs(F.col("x")).alias("signs")), f"select i, (len(regexp_extract_all(x, '(?im)//\\s*[.][.][.]\\s*(remaining|rest|continue|more|etc)')) + len(regexp_extract_all(x, '(?im)//\\s*TODO:?\\s*(implement|add|complete|remaining)')) + len(regexp_extract_all(x, '(?im)//\\s*(omitted|truncated|abbreviated|skipped)')) + len(regexp_extract_all(x, '(?im)[.][.][.]\\s*$')))::int signs from {_values(CUTS)}")


def _totals(m):
    """Totals of each run of the files table: every second run has chunks, every third no analyses; its status follows its number."""
    f = m.files.groupBy("run_id").agg(F.count("*").alias("files"), F.count_if(~F.col("is_copybook")).alias("programs"), F.count_if(~F.col("is_copybook") & (F.col("id") % 3 != 0) & (F.col("run_id") % 3 != 0)).alias("analysed"))
    c = m.chunks.where("run_id % 2 = 0").groupBy("run_id").agg(F.count("*").alias("chunks"), *[F.count_if(F.col("status") == x).alias(x.lower()) for x in ("Completed", "Failed", "Processing", "Pending")])
    d = m.deps.groupBy("run_id").agg(F.count("*").alias("dependencies"))
    out = f.join(c, "run_id", "left").join(d, "run_id", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("run_id") % 4 < 2, "Completed").when(F.col("run_id") % 4 == 2, "Running").otherwise("Failed"))


_tot = "with f as (select run_id, count(*) files, count(*) filter (not is_copybook) programs, count(*) filter (not is_copybook and id % 3 <> 0 and run_id % 3 <> 0) analysed from files group by 1), c as (select run_id, count(*) n, count(*) filter (status = 'Completed') ok, count(*) filter (status = 'Failed') bad, count(*) filter (status = 'Processing') busy, count(*) filter (status = 'Pending') waits from chunks where run_id % 2 = 0 group by 1), d as (select run_id, count(*) nd from deps group by 1), t as (select f.run_id, files, programs, analysed, coalesce(n, 0) n, coalesce(ok, 0) ok, coalesce(bad, 0) bad, coalesce(busy, 0) busy, coalesce(waits, 0) waits, coalesce(nd, 0) nd, run_id % 4 < 2 fin, run_id % 4 = 2 run from f left join c using (run_id) left join d using (run_id)) "
_known = "when (analysed >= programs and programs > 0) or (n > 0 and programs > 0) then 'completed' when n = 0 and fin and analysed = 0 and programs > 0 then 'failed'"
_stages = {
    "file-discovery": "case when files > 0 then 'completed' when run then 'running' else 'pending' end",
    "technical-analysis": f"case {_known} when analysed > 0 and analysed < programs then 'running' when run and files > 0 then 'running' else 'pending' end",
    "business-logic": f"case {_known} when analysed > 0 then 'running' else 'pending' end",
    "dependency-mapping": "case when nd > 0 then 'completed' when run then 'running' else 'pending' end",
    "chunking": "case when n = 0 and programs > 0 then 'completed' when n > 0 then case when ok = n then 'completed' when bad > 0 then 'failed' else 'running' end when fin then 'pending' when nd > 0 then 'running' else 'pending' end",
    "conversion": "case when n = 0 and programs > 0 then case when fin then 'completed' when run then 'running' else 'pending' end when n > 0 then case when ok = n then 'completed' when bad > 0 then 'failed' when busy > 0 then 'running' else 'pending' end else 'pending' end",
    "assembly": "case when n = 0 and programs > 0 then case when fin then 'completed' when run then 'running' else 'pending' end when fin and ok = n and n > 0 then 'completed' when ok > 0 and not fin then 'running' else 'pending' end",
    "output": "case when fin then 'completed' else 'pending' end",
}
_shown = "case when n > 0 then round_even(ok * 100.0::double / n, 1) when fin then 100.0 when analysed > 0 and programs > 0 then least(90.0, round_even(analysed * 100.0::double / programs, 1)) when run then 10.0 else 0.0 end::double"
add("f25_stage_status", lambda m: S.stages(_totals(m)), _tot + " union all ".join(f"select run_id, '{k}' stage, {v} status, {_shown} progress from t" for k, v in _stages.items()))
add("f26_older_than_hour", lambda m: m.runs.where(F.col("started_at") < F.lit(__import__("datetime").datetime(1996, 6, 1)) - F.expr("interval 1 hour")).select("id"), "select id from runs where started_at < timestamp '1996-06-01' - interval 1 hour")
add("f27_backoff", lambda m: m.api.select("id", S.backoff((F.col("tokens") % 10 + 1)).alias("ms")), "select id, least(1000 * pow(2.0, tokens % 10), 120000.0)::double ms from api")
add("f28_default_kind", lambda m: m.deps.select("id", F.coalesce(F.nullif("dependency_type", F.lit("VIEW")), F.lit("DEPENDS_ON")).alias("kind"), F.lower("target_file").endswith(".cpy").alias("copybook")), "select id, case when dependency_type = 'VIEW' then 'DEPENDS_ON' else dependency_type end kind, lower(target_file) like '%.cpy' copybook from deps")
add("f29_live_phase", lambda m: S.live_phase(_totals(m)), _tot + "select run_id, case when run then case when n = 0 and programs > 0 then case when analysed < programs then 'Analyzing Files' else 'Converting' end when busy > 0 then 'Converting Chunks' when waits > 0 then 'Preparing Chunks' when ok > 0 then 'Finalizing' else 'Analyzing' end when fin then 'Complete' end phase, case when n = 0 and programs > 0 then case when fin then 100.0 else coalesce(round_even(analysed::double / programs * 100, 1), 0.0) end else case when n > 0 then round_even(ok::double / n * 100, 1) else 0.0 end end::double progress from t")
add("f30_throughput", lambda m: m.api.groupBy("agent").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms")).select("agent", (F.col("n") / F.greatest(F.col("ms") / 1000.0, F.lit(0.001))).cast("double").alias("rate")), "select agent, count(*) / greatest(sum(duration_ms)::double / 1000.0::double, 0.001) rate from api group by 1")
