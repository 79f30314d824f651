"""Queries of chunking, validation, logs and the accounting of rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import chunking as C
from codequarry.operators import dml as D
from codequarry.operators import validate as V
from codequarry.operators.aggregates import percent, resume_point, total_if
from codequarry.operators.extract import call_edges, external_copies
from codequarry.operators.extract import lines as source_lines
from codequarry.plans import text as T
from codequarry.plans.common import add
from codequarry.staging import numbered, shared_folder
from codequarry.streaming.live import apply_updates, current_status, status_counts
from codequarry.streaming.logs import admissions, admitted, minute_counts, sliding_usage, within

_lines = "(length(content) - length(replace(content, chr(10), '')) + 1)"
_z = "sized as (select id, " + _lines + "::int as lines from files)"
# ---- chunking ----
add("c1_size_routing", lambda m: C.routed(m.files, 5, 5000, 20), f"select id, {_lines}::int as lines, length(content) > 5000 or {_lines} > 20 large, ceil({_lines} / 5)::bigint estimated from files")
_w = "with " + _z + ", n as (select id, lines, greatest(1, ceil(lines / 7))::int n from sized), w as (select id, lines, n, unnest(generate_series(0, n - 1))::int k from n) "
add("c2_line_windows", lambda m: C.windows(C.routed(m.files), 10, 3), _w + "select id, k \"chunk\", n total_chunks, k * 7 + 1 start_line, least(k * 7 + 10, lines) end_line from w")
add("c3_overlap_text", lambda m: C.windows(C.routed(m.files), 10, 3).join(m.files.select("id", "content"), "id").select("id", "chunk", F.md5(F.coalesce(C.overlap_text(F.col("content"), F.col("start_line"), 3), F.lit("")).cast("binary")).alias("h")), _w + "select w.id, k \"chunk\", md5(case when k > 0 then array_to_string(string_split(content, chr(10))[k * 7 - 2 : k * 7], chr(10)) else '' end) h from w join files f on f.id = w.id")
_units = lambda m: m.chunks.select(F.col("source_file").alias("file"), F.col("chunk_index").alias("pos"), F.when(F.col("status") == "Failed", "division").when(F.col("status") == "Completed", "section").otherwise("paragraph").alias("kind"), (F.col("tokens_used") % 40 + 5).alias("lines"), F.col("tokens_used").alias("tokens"))
add("c4_semantic_packing", lambda m: C.packed(_units(m), 100, 1000))
add("c5_policy", lambda m: C.policy(C.routed(m.files), m.files.where("id % 3 = 0").select("id", (F.col("id") % 30).alias("lines")), 8), "with " + _z + " select id, case when lines <= 8 then 'single' when id % 3 <> 0 or id % 30 > 8 then 'windows' else 'semantic' end way from sized")
add("c6_chunk_units", lambda m: C.windows(C.routed(m.files), 10, 3).join(m.files.select("id", F.posexplode(F.split("content", "\n")).alias("p", "t")).select("id", (F.col("p") + 1).alias("line")), "id").where("line between start_line and end_line").groupBy("id", "chunk").agg(F.count("*").alias("held")), _w + "select id, k \"chunk\", (least(k * 7 + 10, lines) - k * 7)::bigint held from w where lines > k * 7")
_plan = lambda m, *limits: (c := C.plan(m.sources, *limits), C.with_texts(c, m.sources, limits[1]))[1]
_hashed = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
add("c5_chunk_plan", lambda m: _plan(m, 60, 8, 400).select("file", "chunk", "total_chunks", "way", "start_line", "end_line", F.array_join("units", " ").alias("units"), _hashed("content").alias("content_hash"), _hashed("before").alias("overlap_hash")))
_parts = lambda m: m.chunks.select(F.col("source_file").alias("file"), F.floor(F.col("chunk_index") / 4).cast("int").alias("chunk"), F.col("chunk_index").alias("pos"), F.concat(F.lit("Unit-"), F.col("chunk_index").cast("string")).alias("name"), "start_line", "end_line")
_links = lambda m: m.chunks.select(F.col("source_file").alias("file"), F.concat(F.lit("UNIT-"), F.col("chunk_index").cast("string")).alias("source"), F.concat(F.lit("unit-"), (F.col("chunk_index") + F.col("id") % 9 - 4).cast("string")).alias("target"))
_joined = lambda *names: [F.array_join(c, " ").alias(c) for c in names]
add("c6_assembly", lambda m: C.assembled(_parts(m), _links(m)).select("file", "chunk", "start_line", "end_line", *_joined("units", "outbound", "inbound")), "with u as (select source_file file, chunk_index // 4 as k, chunk_index i, chunk_index + id % 9 - 4 as j, start_line, end_line from chunks), o as (select file, k, string_agg(distinct 'unit-' || j, ' ' order by 'unit-' || j) t from u where not exists (select 1 from u v where v.file = u.file and v.k = u.k and v.i = u.j) group by 1, 2), b as (select a.file, a.k, string_agg(distinct 'UNIT-' || s.i, ' ' order by 'UNIT-' || s.i) t from u a join u s on s.file = a.file and s.j = a.i and s.k <> a.k group by 1, 2), c as (select file, k, min(start_line) start_line, max(end_line) end_line, string_agg('Unit-' || i, ' ' order by i) units from u group by 1, 2) select c.file, c.k::int \"chunk\", start_line, end_line, units, coalesce(o.t, '') outbound, coalesce(b.t, '') inbound from c left join o on o.file = c.file and o.k = c.k left join b on b.file = c.file and b.k = c.k")
add("c7_split_point", lambda m: C.split_point(source_lines(m.files.select(F.col("file_name").alias("file"), F.regexp_replace("content", r"(?i)\bthe\b", "SECTION").alias("content")))).select("file", "at"), "with l as (select file_name file, i::int as line, t[i] as text, len(t) n from (select file_name, string_split(regexp_replace(content, '(?i)\\bthe\\b', 'SECTION', 'g'), chr(10)) t, unnest(generate_series(1, len(string_split(content, chr(10))))) i from files)), r as (select *, n // 2 mid, abs(line - n // 2) far, case when regexp_matches(upper(text), '\\bDIVISION\\b') then 0 when regexp_matches(upper(text), '\\bSECTION\\b') then 1 when regexp_matches(upper(text), '^\\s{7}[A-Z0-9-]+\\.\\s*$') then 2 end rk from l), b as (select file, arg_min(line, row(rk, far, line)) found from r where rk is not null and far <= n * 0.25 and line > 10 and line <= n - 10 group by 1) select file, coalesce(found, mid)::int \"at\" from (select distinct file, mid from r) left join b using (file)")
add("c8_plan_summary", lambda m: C.plan_summary(C.windows(C.routed(m.files), 10, 3), 10), _w + "select id, count(*) chunks, max(least(10, lines - k * 7)) longest, true as valid from w group by 1")
add("c9_resume", lambda m: m.chunks.join(resume_point(m.chunks, "source_file"), "source_file").where("chunk_index > last_completed").select("id"), "select id from (select id, chunk_index, max(case when status = 'Completed' then chunk_index end) over (partition by source_file) c from chunks) where chunk_index > coalesce(c, -1)")
_short = "length('// Chunk ' || chunk_index || ': ' || status || ' - ' || len(units) || ' units: ' || array_to_string(units[1:5], ', ') || '...') + 1"
_full = "length('// Chunk ' || chunk_index || ': ' || status) + 1 + coalesce(list_sum(list_transform(units, lambda u: length(u) + 8)), 0)"
_ctx = f"with x as (select *, {_short} c, {_full} f, count(*) over (partition by source_file) n from described), y as (select *, count(*) filter (status = 'Completed') over w signatures, coalesce(sum(length('void m' || chunk_index || '()') // 4 + 20) filter (status = 'Completed') over w, 0) st, count(*) filter (id % 3 = 0) over w mappings, count(*) filter (status = 'Failed') over w open_refs, coalesce(sum(c) over (partition by source_file order by chunk_index rows between unbounded preceding and 4 preceding), 0) + coalesce(sum(f) over (partition by source_file order by chunk_index rows between 3 preceding and 1 preceding), 0) + case when chunk_index > 0 then 44 else 0 end hist from x window w as (partition by source_file order by chunk_index rows between unbounded preceding and 1 preceding)) "
_signed = lambda m: m.chunks.where("status = 'Completed'").withColumn("target_signature", F.concat(F.lit("void m"), F.col("chunk_index").cast("string"), F.lit("()")))
add("c10_context", lambda m: C.context(m.described, _signed(m), m.chunks.where("id % 3 = 0"), m.chunks.where("status = 'Failed'")), _ctx + "select source_file, chunk_index, signatures, mappings, open_refs, (length('Processing chunk ' || (chunk_index + 1) || ' of ' || n || ' from ' || source_file || ' (lines ' || start_line || '-' || end_line || '). Contains ' || len(units) || ' semantic units.') // 4 + st + 30 * mappings + hist // 4 + 40 * open_refs)::bigint tokens from y")

# ---- validation ----
_reg = lambda m: D.first_wins(m.sigs, ["run_id", "legacy_name"], "seq")
_uses = lambda m: m.sigs.withColumnRenamed("seq", "id")
_iss = "with r as (select run_id, legacy_name, arg_min(method, seq) rm, arg_min(return_type, seq) rt, arg_min(n_params, seq) rn, arg_min(params, seq) rp from sigs group by 1, 2), u as (select seq id, s.run_id, method, return_type, n_params, params, rm, rt, rn, rp from sigs s join r on r.run_id = s.run_id and r.legacy_name = s.legacy_name), i as (select id, run_id, 'MethodNameMismatch' issue, rm expected, method actual, 'Error' severity from u where method <> rm union all select id, run_id, 'ReturnTypeMismatch', rt, return_type, 'Error' from u where return_type <> rt union all select id, run_id, 'ParameterCountMismatch', rn::varchar, n_params::varchar, 'Critical' from u where n_params <> rn union all select id, run_id, 'Parameter[' || i || '].Type', rp[i + 1], params[i + 1], 'Error' from (select *, unnest(generate_series(0, n_params - 1)) i from u where n_params = rn) where rp[i + 1] <> params[i + 1]) "
add("v1_signature_issues", lambda m: V.signature_issues(_uses(m), _reg(m)), _iss + "select id, issue, expected, actual, severity from i")
_map = lambda m: m.sigs.groupBy(F.col("legacy_name").alias("key")).agg(F.min("return_type").alias("type"), F.min("method").alias("field"))
add("v2_type_issues", lambda m: V.type_issues(m.sigs.select(F.col("seq").alias("id"), F.col("legacy_name").alias("key"), F.col("return_type").alias("type"), F.col("method").alias("field")), _map(m)), "with k as (select legacy_name, min(return_type) t, min(method) f from sigs group by 1) select seq id, case when return_type <> t then 'Error' else 'Warning' end severity from sigs join k using (legacy_name) where return_type <> t or method <> f")
add("v3_severity_counts", lambda m: V.signature_issues(_uses(m), _reg(m)).groupBy("issue", "severity").agg(F.count("*").alias("n")), _iss + "select issue, severity, count(*) n from i group by 1, 2")
add("v4_validity", lambda m: V.validity(V.signature_issues(_uses(m), _reg(m)), "issue").select("issue", "valid"), _iss + "select issue, max(case severity when 'Critical' then 3 when 'Error' then 2 else 1 end) < 2 as valid from i group by 1")
#: A file's text, and the names that the program beside it refers to: its copybooks, and what its paragraphs call.
_code = lambda m: m.files.select(F.col("file_name").alias("file"), F.col("content").alias("code"))
_copied = lambda m: external_copies(m.sources).select("file", F.concat_ws("-", F.substring("name", 1, 2), F.expr("substr(name, 3)")).alias("name")).distinct()
_called = lambda m: call_edges(m.sources).select("file", F.col("callee").alias("name")).distinct()
_n_copied = T._ln + f", n as (select distinct file, s[1:2] || '-' || s[3:] as name from (select file, regexp_extract(u, {T._ext}, 1) s from c where regexp_matches(u, {T._ext}))), code as (select file_name file, content from files)"
_n_called = T._cal + ", n as (select distinct file, callee as name from edges), code as (select file_name file, content from files)"
_leak = " select n.file, n.name from n join code c on c.file = n.file where contains(lower(content), lower(n.name)) or contains(lower(content), replace(lower(n.name), '-', ''))"
add("v5_unconverted_names", lambda m: V.unconverted(_copied(m).withColumn("method", F.lower(F.substring("name", 1, 1))), _code(m)), "with " + _n_copied + " select n.file, n.name, 'Warning' severity from n join code c on c.file = n.file where contains(lower(content), replace(lower(n.name), '-', '')) and not contains(content, lower(n.name[1]) || '(')")
add("j13_text_containment", lambda m: V.leaks(_copied(m), _code(m)).groupBy("file").agg(F.count("*").alias("n")), "with " + _n_copied + f" select file, count(*) n from ({_leak}) group by 1")
add("v7_variable_leaks", lambda m: V.leaks(_called(m), _code(m)), "with " + _n_called + _leak)
add("v6_unresolved_refs", lambda m: D.resolve(m.refs, m.sigs.where("seq % 3 = 0").groupBy("run_id", "method").agg(F.min("return_type").alias("signature"))).where("not resolved").select("id", F.lit("Error").alias("severity")), "select id, 'Error' severity from refs where not resolved and not exists (select 1 from sigs where seq % 3 = 0 and sigs.run_id = refs.run_id and sigs.method = refs.target_method)")
add("v8_fix_plan", lambda m: V.fix_plan(V.signature_issues(_uses(m), _reg(m)).join(m.sigs.select(F.col("seq").alias("id"), "run_id"), "id"), 5).select("run_id", "id", "issue", "n"), _iss + "select run_id, id, issue, row_number() over (partition by run_id order by id, issue)::int n from i qualify n <= 5")
_typed = "with k as (select legacy_name, min(return_type) t, min(method) f from sigs group by 1), t as (select run_id, return_type = t and method = f ok from sigs join k using (legacy_name)), "
add("v9_consistency", lambda m: V.consistency(V.unflagged(_uses(m), V.signature_issues(_uses(m), _reg(m))), V.unflagged(_uses(m), V.type_issues(_uses(m).select("id", F.col("legacy_name").alias("key"), F.col("return_type").alias("type"), F.col("method").alias("field")), _map(m))), m.refs.select("run_id", F.col("resolved").alias("ok"))), _typed + _iss.removeprefix("with ") + ", s as (select run_id, 100.0::double * count(*) filter (id not in (select id from i)) / count(*) methods from u group by 1), v as (select run_id, 100.0::double * count(*) filter (ok) / count(*) \"variables\" from t group by 1), f as (select run_id, 100.0::double * count(*) filter (resolved) / count(*) refs from refs group by 1) select * from s join v using (run_id) join f using (run_id)")

# ---- logs and rates ----
add("j10_run_window", lambda m: within(m.api.select("id", "ts"), m.spans, 5).select("id", "run"), "select id, run from api join spans on ts >= s - interval 5 second and (e is null or ts <= e + interval 5 second)")
add("j11_loose_window", lambda m: m.api.select("id", F.when(F.col("id") % 10 == 0, "garbled").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("t")).withColumn("ts", F.expr("try_to_timestamp(t, 'yyyy-MM-dd HH:mm:ss')")).where("ts is null or ts between timestamp'2024-01-02 02:59:00' and timestamp'2024-01-05 00:01:00'").select("id"), "select id from api where id % 10 = 0 or date_trunc('second', ts) between timestamp '2024-01-02 02:59:00' and timestamp '2024-01-05 00:01:00'")
add("s6_double_encoded", lambda m: m.table("events").select(F.col("event_id").alias("id"), F.to_json(F.struct(F.col("props").alias("data"))).alias("v")).select("id", F.get_json_object(F.get_json_object("v", "$.data"), "$.k").cast("bigint").alias("k")), "select event_id id, (props ->> '$.k')::bigint k from events")
add("s7_nested_array", lambda m: m.table("events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"calls":['), "props", F.lit(","), "props", F.lit("]}")).alias("v")).select("id", F.explode(F.from_json("v", "calls array<struct<k:bigint>>")["calls"]).alias("c")).select("id", "c.k"), "select event_id id, unnest([(props ->> '$.k')::bigint, (props ->> '$.k')::bigint]) k from events")
add("l4_since", lambda m: m.api.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("id"), "select id from api where ts >= timestamp '2024-01-15'")
add("l5_live_status", lambda m: m.chunks.groupBy("run_id").pivot("status", ["Pending", "Processing", "Completed", "Failed"]).count().na.fill(0).toDF("run_id", "pending", "processing", "completed", "failed"), "select run_id, count(*) filter (status = 'Pending') pending, count(*) filter (status = 'Processing') processing, count(*) filter (status = 'Completed') completed, count(*) filter (status = 'Failed') failed from chunks group by 1")
add("l6_narrative", lambda m: numbered(m.api.select("id", "model", "ts", "agent"), "model", "ts", "agent", "id").select("id", "n"), "select id, row_number() over (order by model, ts, agent, id) n from api")
add("l2_sliding_usage", lambda m: admitted(sliding_usage(m.api.select("ts", "tokens"), "60 seconds", "30 seconds"), 300, 3).select(F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start"), "tokens", "requests", "admit"), "select b * 30 as start, sum(tokens)::bigint tokens, count(*) requests, sum(tokens) < 300 and count(*) < 3 admit from (select tokens, unnest([epoch(ts)::bigint // 30, epoch(ts)::bigint // 30 - 1]) b from (select tokens, date_trunc('second', ts) ts from api)) group by b")
_anchored = "with recursive c as (select agent, id, ts, row_number() over (order by agent, ts, id) n from api), b as (select agent, ts t, 1 k, n from c union all select agent, ts + interval {0} second, 0, n from c), f as (select k, n, min(case when k = 1 then n end) over (partition by agent order by t, k, n rows between current row and unbounded following) nxt from b), j as (select n, nxt from f where k = 0), a as (select min(n) n from c group by agent union all select nxt from a join j using (n) where nxt is not null) select id, (c.n - max(a.n) over (partition by agent order by c.n) + 1)::int used from c left join a on a.n = c.n"
add("l3_anchored_minute", lambda m: minute_counts(m.api).select("id", "used"), _anchored.format(60))
add("l3_anchored_hour", lambda m: minute_counts(m.api, 3600).select("id", "used"), _anchored.format(3600))
add("l2_admission", lambda m: admissions(m.api, 100, 4, 3600, peers=True), "with w as (select id, ts, tokens, coalesce(sum(tokens) over p, 0) t, count(*) over p n, min(ts) over p o from api window p as (partition by agent order by ts range between interval 3600 second preceding and current row exclude current row)) select id, t + tokens <= 100 and n + 1 <= 4 admit, case when t + tokens <= 100 and n + 1 <= 4 then 0 else epoch_us(coalesce(o, ts) + interval 3600 second - ts) // 1000 end::bigint wait_ms, case when t + tokens > 100 then 'TPM' when n + 1 > 4 then 'RPM' else 'OK' end reason from w")


def _live(m):
    """Updates in three batches, one of which comes twice."""
    at = shared_folder(m.spark)
    rows = m.chunks.select("run_id", "source_file", F.floor(F.col("chunk_index") / 3).alias("chunk_index"), "status", F.col("id").alias("ts"))
    for batch in (0, 1, 2, 1):
        apply_updates(rows.where(F.col("ts") % 3 == batch), batch, at)
    return status_counts(current_status(m.spark, at))


add("l5_live_upsert", _live, "with s as (select run_id, source_file, chunk_index // 3 k, arg_max(status, id) status from chunks group by 1, 2, 3) select run_id, count(*) filter (status = 'Pending') pending, count(*) filter (status = 'Processing') processing, count(*) filter (status = 'Completed') completed, count(*) filter (status = 'Failed') failed from s group by 1")
add("j16_parent_by_level", lambda m: C.nearest_lower(m.chunks.select(F.col("source_file").alias("file"), F.col("chunk_index").alias("pos"), (F.col("tokens_used") % 5).alias("level"))), "with x as (select source_file file, chunk_index pos, tokens_used % 5 as level from chunks) select a.file, a.pos, a.level, max(b.pos) parent from x a left join x b on a.file = b.file and b.pos < a.pos and b.level < a.level group by 1, 2, 3")
