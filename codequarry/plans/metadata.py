"""Queries over the metadata tables: scans, filters, joins, aggregates, sorts, set operations, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codequarry.operators import aggregates as A
from codequarry.operators import filters as P
from codequarry.operators.chunking import history, overlaps
from codequarry.plans.common import add
from codequarry.streaming.logs import trailing_usage

TYPES = ["CLICK", "ERROR", "PURCHASE", "VIEW", "SIGNUP"]
PCT = "coalesce(100.0 * {a} / nullif({b}, 0), 0)::double"

# ---- scans ----
add("s2_scan_by_run", lambda m: P.by_run(m.files, 3).select("id", "file_name", "is_copybook"), "select id, file_name, is_copybook from files where run_id = 3")
add("s3_can_process", lambda m: m.files.where(F.col("file_name").rlike(r"(?i)\.(cbl|cob|cobol|cpy)$") | F.col("content").rlike(r"(?i)(IDENTIFICATION|PROCEDURE|DATA)\s+DIVISION")).select("id"), "select id from files where regexp_matches(file_name, '(?i)\\.(cbl|cob|cobol|cpy)$') or regexp_matches(content, '(?i)(IDENTIFICATION|PROCEDURE|DATA)\\s+DIVISION')")
add("s9_tail", lambda m: m.chunks.orderBy(F.desc("id")).limit(50).orderBy("id").select("id", "status"), "select id, status from (select id, status from chunks order by id desc limit 50)")
add("s12_row_counts", lambda m: m.runs.agg(F.count("*").alias("n")).withColumn("t", F.lit("runs")).unionByName(m.files.agg(F.count("*").alias("n")).withColumn("t", F.lit("files"))).unionByName(m.chunks.agg(F.count("*").alias("n")).withColumn("t", F.lit("chunks"))).unionByName(m.deps.agg(F.count("*").alias("n")).withColumn("t", F.lit("deps"))), "select count(*) n, 'runs' t from runs union all select count(*), 'files' from files union all select count(*), 'chunks' from chunks union all select count(*), 'deps' from deps")
_ends = ["", ".cbl", ".cpy", ".cob", ".pl1", ".jcl"]
add("s14_source_lookup", lambda m: m.files.where(F.lower("file_name").isin([f"doc_7{e}" for e in _ends] + [f"doc_123{e}" for e in _ends])).select("id", F.when(F.length("content") > 5_000_000, F.substring("content", 1, 5000)).otherwise(F.col("content")).alias("content")), "select id, case when length(content) > 5000000 then substr(content, 1, 5000) else content end as content from files where lower(file_name) in (" + ", ".join(f"'doc_{n}{e}'" for n in (7, 123) for e in _ends) + ")")

# ---- filters and projections ----
add("p1_bound_equality", lambda m: P.by_run(m.chunks, 4, "f14").select("id", "chunk_index"), "select id, chunk_index from chunks where run_id = 4 and source_file = 'f14'")
add("p2_search", lambda m: P.search(m.files, "THE").select("id", "file_name"), "select id, file_name from files where file_name ilike '%THE%' or content ilike '%THE%'")
add("p3_mentions", lambda m: P.mentions(m.analyses, "raw_analysis", "ouin", "THTI").select("id"), "select id from analyses where raw_analysis ilike '%ouin%' or raw_analysis ilike '%THTI%'")
add("p4_recent_activity", lambda m: P.recent(m.chunks, "completed_at", 25, F.desc("id")).select("id", "completed_at"), "select id, completed_at from chunks where completed_at is not null order by completed_at desc, id desc limit 25")
add("p5_before_chunk", lambda m: P.before_chunk(m.chunks, 3).select("id", "chunk_index"), "select id, chunk_index from chunks where chunk_index < 3")
add("p6_defaults", lambda m: P.defaulted(m.runs, notes="").select("id", "notes"), "select id, coalesce(notes, '') notes from runs")
add("p7_status_by_outer_join", lambda m: m.files.join(m.analyses.select(F.col("cobol_file_id").alias("id"), F.lit(1).alias("hit")), "id", "left").select("id", F.when(F.col("hit").isNotNull(), "Analyzed").otherwise("Pending").alias("state")), "select f.id, case when a.id is not null then 'Analyzed' else 'Pending' end state from files f left join analyses a on a.cobol_file_id = f.id")
add("p8_unresolved", lambda m: P.unresolved(m.refs).select("id", "target_method"), "select id, target_method from refs where not resolved")
add("p9_point_lookup", lambda m: P.one_each(m.sigs, ["source_file", "legacy_name"], "seq").select("source_file", "legacy_name", "method"), "select source_file, legacy_name, arg_min(method, seq) as method from sigs group by all")
add("p10_target_language", lambda m: m.runs.select("id", P.target_language(F.col("java_output")).alias("language")), "select id, case when contains(lower(java_output), 'csharp') then 'C#' when contains(lower(java_output), 'java') or lower(java_output) = 'output' then 'Java' end as language from runs")
add("p11_visible_edges", lambda m: P.visible_edges(m.deps, m.deps.where("line_number < 60").select(F.col("source_file").alias("file")), ["CLICK", "VIEW"]).select("id", "source_file", "target_file"), "with n as (select distinct source_file f from deps where line_number < 60) select id, source_file, target_file from deps where dependency_type in ('CLICK', 'VIEW') and source_file in (select f from n) and target_file in (select f from n)")
add("p12_data_access", lambda m: P.data_access(m.deps, ("CLICK", "ERROR")).select("id"), "select id from deps where dependency_type in ('CLICK', 'ERROR')")
add("p13_seconds", lambda m: m.chunks.select("id", (F.col("processing_time_ms") / 1000.0).cast("double").alias("seconds")), "select id, (processing_time_ms / 1000.0)::double as seconds from chunks")
add("p14_exact_name", lambda m: P.one_each(m.files.where(F.lower("file_name").isin("doc_1.cbl", "doc_1.cpy", "doc_7.cbl") | (F.lower("file_name") == F.lower(F.lit("DOC_7.CPY")))), ["run_id"], "id").select("id", "file_name"), "select min(id) id, arg_min(file_name, id) file_name from files where file_name in ('doc_1.cbl', 'doc_1.cpy', 'doc_7.cbl', 'doc_7.cpy') group by run_id")
add("p15_resume_target", lambda m: m.runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1).select("id", "status"), "select id, status from runs order by started_at desc, id desc limit 1")

# ---- joins ----
add("j1_analyses_files", lambda m: m.analyses.join(m.files.withColumnRenamed("id", "cobol_file_id"), "cobol_file_id").select("cobol_file_id", "file_name", "program_description"), "select a.cobol_file_id, f.file_name, a.program_description from analyses a join files f on f.id = a.cobol_file_id")
add("j2_join_count", lambda m: m.analyses.join(m.files.select(F.col("id").alias("cobol_file_id"), "run_id"), "cobol_file_id").groupBy("run_id").agg(F.count("*").alias("n")), "select run_id, count(*) n from analyses a join files f on f.id = a.cobol_file_id group by run_id")
add("j3_files_left_analyses", lambda m: m.files.join(m.analyses.select(F.col("cobol_file_id").alias("id"), "program_description"), "id", "left").select("id", "file_name", "program_description"), "select f.id, f.file_name, a.program_description from files f left join analyses a on a.cobol_file_id = f.id")
add("j4_left_provenance", lambda m: m.table("customer").select("c_custkey", "c_nationkey").join(m.table("nation").where("n_regionkey > 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"), "select c_custkey, n_name from customer left join (select * from nation where n_regionkey > 1) on c_nationkey = n_nationkey")
add("j5_left_point", lambda m: P.by_run(m.files, 2).where("id = 12").join(m.analyses.select(F.col("cobol_file_id").alias("id"), "program_description"), "id", "left").select("id", "program_description"), "select f.id, a.program_description from files f left join analyses a on a.cobol_file_id = f.id where f.run_id = 2 and f.id = 12")
add("j6_run_metrics", lambda m: m.runs.select("id", "status").join(m.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", "status", "n"), "select r.id, r.status, l.n from runs r left join (select l_orderkey, count(*) n from lineitem group by 1) l on l.l_orderkey = r.id")
add("j7_semi", lambda m: m.analyses.join(P.by_run(m.files, 5).select(F.col("id").alias("cobol_file_id")), "cobol_file_id", "left_semi").select("id"), "select id from analyses where cobol_file_id in (select id from files where run_id = 5)")
add("j8_inferred_nodes", lambda m: m.deps.select(F.col("source_file").alias("file")).union(m.deps.select("target_file")).distinct().join(m.chunks.where("run_id < 7").select(F.col("source_file").alias("file")).distinct(), "file", "left_anti"), "select file from (select source_file file from deps union select target_file from deps) where file not in (select source_file from chunks where run_id < 7)")
add("j9_unknown_signatures", lambda m: m.refs.join(m.sigs.where("seq % 3 = 0").select(F.lower("method").alias("k")).distinct(), F.lower("target_method") == F.col("k"), "left_anti").select("id", "target_method"), "select id, target_method from refs where lower(target_method) not in (select lower(method) from sigs where seq % 3 = 0)")
add("j12_overlap", lambda m: overlaps(m.chunks, m.chunks), "select c.id \"chunk\", u.id unit from chunks c join chunks u on c.source_file = u.source_file and u.start_line <= c.end_line and u.end_line >= c.start_line")
add("j14_line_counts", lambda m: m.deps.select("source_file").distinct().join(A.file_spans(m.chunks, "source_file").select("source_file", "last_line"), "source_file", "left"), "select d.source_file, c.last_line from (select distinct source_file from deps) d left join (select source_file, max(end_line) last_line from chunks group by 1) c using (source_file)")
add("j15_generated_mapping", lambda m: m.files.join(m.analyses.select(F.col("cobol_file_id").alias("id"), F.col("program_description").alias("g")), "id", "left").orderBy("id").limit(20).select("id", F.coalesce("g", F.lit("Not Generated")).alias("generated")), "select f.id, coalesce(a.program_description, 'Not Generated') as generated from files f left join analyses a on a.cobol_file_id = f.id order by f.id limit 20")
add("j18_prompt_containment", lambda m: P.mentioned(m.chat.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "agent").alias("prompt"), F.concat("message", F.lit(" see DOC_"), (F.col("conv_id") * 7 % 1000).cast("string"), F.lit(".cbl")).alias("text")), m.files.select("file_name").distinct()), "with p as (select conv_id || '/' || turn || '/' || agent prompt, lower(message || ' see DOC_' || (conv_id * 7 % 1000) || '.cbl') t from chat), f as (select distinct file_name, regexp_replace(lower(file_name), '[.][^.]*$', '') stem from files) select prompt, file_name from p join f on contains(t, stem) qualify row_number() over (partition by prompt order by file_name) <= 5")

# ---- aggregates ----
_chunk = "count(*) total, count(*) filter (status = 'Completed') completed, count(*) filter (status = 'Failed') failed, count(*) filter (status in ('Pending', 'Processing')) pending, coalesce(sum(processing_time_ms), 0)::bigint time_ms, coalesce(sum(tokens_used), 0)::bigint tokens, coalesce(count(*) filter (status = 'Completed')::double * 100 / nullif(count(*), 0), 0) progress"
add("a1_chunk_status_by_file", lambda m: A.chunk_status(m.chunks, "run_id", "source_file"), f"select run_id, source_file, {_chunk} from chunks group by all")
add("a2_run_totals", lambda m: A.chunk_status(m.chunks), f"select {_chunk} from chunks")
add("a3_status_pivot", lambda m: A.status_pivot(m.chunks), "select count(*) filter (status = 'Pending') pending, count(*) filter (status = 'Processing') processing, count(*) filter (status = 'Completed') completed, count(*) filter (status = 'Failed') failed from chunks")
add("a4_file_stats", lambda m: A.file_stats(m.files), "select count(*) total, count(*) filter (not is_copybook) programs, count(*) filter (is_copybook) copybooks from files")
add("a5_distinct_by_suffix", lambda m: A.distinct_by_suffix(m.files), "select count(distinct file_name) files, count(distinct case when lower(file_name) like '%.cbl' then file_name end) cbl, count(distinct case when lower(file_name) like '%.cpy' then file_name end) cpy from files")
add("a6_type_counts", lambda m: A.type_counts(m.deps, TYPES), "select count(*) total, " + ", ".join(f"count(*) filter (dependency_type = '{t}') {t.lower()}" for t in TYPES) + " from deps")
add("a7_distinct_files", lambda m: m.chunks.agg(F.countDistinct("source_file").alias("n")), "select count(distinct source_file) n from chunks")
add("a8_top_by_run", lambda m: m.chunks.groupBy("run_id", "source_file").agg(F.count("*").alias("n")).orderBy(F.desc("run_id"), "source_file").limit(5), "select run_id, source_file, count(*) n from chunks group by all order by run_id desc, source_file limit 5")
add("a9_file_extent", lambda m: A.file_spans(m.chunks, "source_file").drop("span"), "select source_file, count(*) chunks, min(start_line) first_line, max(end_line) last_line from chunks group by 1")
add("a10_having", lambda m: m.chunks.groupBy("source_file").agg(F.count("*").alias("n")).where("n > 5").orderBy("source_file").limit(1), "select source_file, count(*) n from chunks group by 1 having count(*) > 5 order by 1 limit 1")
add("a11_resume_point", lambda m: A.resume_point(m.chunks, "source_file"), "select source_file, coalesce(max(chunk_index) filter (status = 'Completed'), -1)::int last_completed from chunks group by 1")
add("a12_exists", lambda m: m.sigs.agg((A.total_if((F.col("source_file") == "f7") & (F.col("legacy_name") == "CLICK")) > 0).alias("found")), "select count(*) > 0 as found from sigs where source_file = 'f7' and legacy_name = 'CLICK'")
add("j6_run_circular", lambda m: m.runs.where("id < 10").select("id", "status").join(A.run_circular(m.links), F.col("id") == F.col("run_id"), "left").select("id", "status", F.coalesce("circular_components", F.lit(0)).alias("circular_components"), F.coalesce("circular_files", F.lit(0)).alias("circular_files")), "with recursive e as (select distinct run_id r, source_file src, target_file dst from links where source_file <> target_file), w as (select distinct r, src a, src b from e union select w.r, a, dst from w join e on e.r = w.r and e.src = w.b), c as (select x.r, x.a file, min(x.b) scc from w x join w y on y.r = x.r and y.a = x.b and y.b = x.a group by 1, 2), z as (select r, scc, count(*) size from c group by 1, 2 having count(*) > 1), g as (select r, count(*) n, sum(size)::bigint f from z group by 1) select id, status, coalesce(n, 0) circular_components, coalesce(f, 0) circular_files from runs left join g on g.r = id where id < 10")
_circular = "with recursive e as (select distinct source_file src, target_file dst from links where source_file <> target_file), w as (select distinct src a, src b from e union select a, dst from w join e on e.src = w.b), c as (select x.a file, min(x.b) scc from w x join w y on y.a = x.b and y.b = x.a group by 1), z as (select scc, count(*) size from c group by 1 having count(*) > 1)"
add("a13_dependency_metrics", lambda m: A.dependency_metrics(m.links, m.copies).withColumn("circular_dependencies", F.array_join("circular_dependencies", "; ")), _circular + ", u as (select copybook, count(*) n from copies group by 1) select (select count(distinct source_file) from links) programs, (select count(*) from links) dependencies, (select count(*)::double / count(distinct source_file) from links) average, (select count(*) from u) copybooks, (select max(n) from u) most_used_count, (select copybook from u order by n desc, copybook limit 1) most_used, (select count(*) from z) circular_components, (select coalesce(sum(size), 0)::bigint from z) circular_files, (select string_agg(scc || ': ' || size || ' files', '; ' order by size desc, scc) from z) circular_dependencies")
add("a14_reverse_index", lambda m: A.usage_index(m.copies, "copybook", "program"), "select copybook, array_to_string(list_sort(list(distinct program)), ',') members, count(distinct program)::int n from copies group by 1")
add("a15_forward_index", lambda m: A.usage_index(m.copies, "program", "copybook"), "select program, array_to_string(list_sort(list(distinct copybook)), ',') members, count(distinct copybook)::int n from copies group by 1")
add("a16_top_copybooks", lambda m: m.copies.groupBy("copybook").agg(F.countDistinct("program").alias("programs")).orderBy(F.desc("programs"), "copybook").limit(10), "select copybook, count(distinct program) programs from copies group by 1 order by 2 desc, 1 limit 10")
add("a17_report_metrics", lambda m: A.report_metrics(m.files, m.api.agg(((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6).alias("minutes"))), "with t as (select (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 as minutes from api) select count(*) files, sum(length(content))::double / count(*) mean_length, sum(len(string_split(content, chr(10))))::bigint as lines, count(*)::double / greatest((select minutes from t), 1.0) per_minute from files")
add("a18_agent_actions", lambda m: m.api.groupBy("agent", "model").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms")).groupBy("agent").agg(F.sum("n").alias("calls"), F.sum("ms").alias("total_ms"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "model", F.col("n").cast("string")))), ",").alias("histogram")), "with g as (select agent, model, count(*) n, sum(duration_ms) ms from api group by all) select agent, sum(n)::bigint calls, sum(ms)::bigint total_ms, array_to_string(list_sort(list(model || '=' || n)), ',') histogram from g group by 1")
_call = "count(*) calls, count(*) filter (ok) succeeded, count(*) filter (not ok) failed, sum(duration_ms)::bigint duration_ms, min(duration_ms) shortest, max(duration_ms) longest, sum(tokens)::bigint tokens, sum(micros)::bigint micros, sum(duration_ms)::double / count(*) mean_ms, coalesce(sum(micros) * 1000.0::double / nullif(sum(tokens), 0), 0)::double per_1k"
add("a19_call_stats", lambda m: A.call_stats(m.api), f"select {_call} from api")
add("a20_by_agent", lambda m: A.call_stats(m.api, "agent"), f"select agent, {_call} from api group by 1")
add("a21_by_model", lambda m: A.call_stats(m.api, "model"), f"select model, {_call} from api group by 1")
add("a22_cost_by_agent", lambda m: A.call_stats(m.api, "agent").select("agent", "micros", "per_1k").orderBy(F.desc("micros"), "agent"), "select agent, sum(micros)::bigint micros, coalesce(sum(micros) * 1000.0::double / nullif(sum(tokens), 0), 0)::double per_1k from api group by 1")
add("a23_session_summary", lambda m: A.call_stats(m.api, "agent").orderBy("agent").agg(F.sum("calls").alias("calls"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "agent", F.col("calls").cast("string")))), ";").alias("by_agent")), "with g as (select agent, count(*) n from api group by 1) select sum(n)::bigint calls, array_to_string(list_sort(list(agent || ':' || n)), ';') by_agent from g")
add("a24_chat_stats", lambda m: m.chat.groupBy("agent").agg(F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.countDistinct("conv_id").alias("sessions"), (F.max("turn") - F.min("turn")).alias("span")), "select agent, count(*) messages, sum(tokens)::bigint tokens, count(distinct conv_id) sessions, max(turn) - min(turn) as span from chat group by 1")
add("a25_categories", lambda m: m.api.agg(*[F.count_if(F.upper("agent").contains(c)).alias(c.lower()) for c in ("CLICK", "ERROR", "VIEW")], F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("micros")), "select count(*) filter (contains(upper(agent), 'CLICK')) click, count(*) filter (contains(upper(agent), 'ERROR')) error, count(*) filter (contains(upper(agent), 'VIEW')) \"view\", epoch_us(max(ts)) - epoch_us(min(ts)) micros from api")
add("a26_mean_progress", lambda m: A.chunk_status(m.chunks, "source_file").agg(F.round(F.avg("progress"), 6).alias("overall")), "select round(avg(p), 6) overall from (select 100.0::double * count(*) filter (status = 'Completed') / count(*) p from chunks group by source_file)")
add("a27_signature_counts", lambda m: m.sigs.agg(F.countDistinct("legacy_name").alias("names"), F.count("*").alias("n"), F.countDistinct("source_file").alias("files")), "select count(distinct legacy_name) names, count(*) n, count(distinct source_file) files from sigs")
add("a28_small_files", lambda m: A.small_files(m.files, m.chunks), "with n as (select (select count(*) filter (not is_copybook) from files) programs, (select count(distinct source_file) from chunks) chunked) select programs, chunked, greatest(0, programs - chunked) small, chunked > 0 smart from n")
add("a29_json_sizes", lambda m: m.analyses.select("id", *[F.coalesce(F.json_array_length(f"{k}_json"), F.lit(0)).alias(k) for k in ("paragraphs", "variables")]), "select id, coalesce(json_array_length(paragraphs_json), 0)::int paragraphs, coalesce(json_array_length(variables_json), 0)::int as variables from analyses")
add("a30_chunked_report", lambda m: A.chunk_status(m.chunks, "source_file").agg(F.sum("total").alias("chunks"), F.sum("completed").alias("ok"), F.sum("failed").alias("failed"), A.total_if(F.col("failed") == 0).alias("consistent")), "with g as (select count(*) n, count(*) filter (status = 'Completed') c, count(*) filter (status = 'Failed') f from chunks group by source_file) select sum(n)::bigint chunks, sum(c)::bigint ok, sum(f)::bigint as failed, count(*) filter (f = 0) consistent from g")
add("a31_success_rate", lambda m: A.chunk_status(m.chunks, "run_id").select("run_id", A.percent(F.col("completed"), F.col("completed") + F.col("failed")).alias("rate")), "select run_id, coalesce(100.0::double * count(*) filter (status = 'Completed') / nullif(count(*) filter (status in ('Completed', 'Failed')), 0), 0) rate from chunks group by 1")
add("a32_file_detail", lambda m: A.chunk_status(m.chunks, "source_file").select("source_file", "completed", F.bround("progress", 2).alias("progress"), "tokens", "time_ms").join(A.file_spans(m.chunks, "source_file").select("source_file", "span"), "source_file"), "select source_file, count(*) filter (status = 'Completed') completed, round_even(100.0::double * count(*) filter (status = 'Completed') / count(*), 2) progress, sum(tokens_used)::bigint tokens, sum(processing_time_ms)::bigint time_ms, max(end_line) - min(start_line) + 1 as span from chunks group by 1")
add("a33_extract_totals", lambda m: A.extract_totals(m.extracts), "select " + ", ".join(f"sum(coalesce(json_array_length({k}_json), 0))::bigint {k}" for k in ("stories", "features", "rules")) + ", count(*) filter (is_copybook) copybooks, count(*) filter (not is_copybook) programs from extracts")

# ---- sorts and limits ----
add("o1_latest_run", lambda m: m.runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1).select("id", "started_at"), "select id, started_at from runs order by started_at desc, id desc limit 1")
add("o2_last_runs", lambda m: m.runs.orderBy(F.desc("id")).limit(5).select("id", "status"), "select id, status from runs order by id desc limit 5")
add("o3_multi_key", lambda m: m.deps.orderBy("source_file", "dependency_type", "target_file", "id").limit(100).select("id", "source_file", "dependency_type", "target_file"), "select id, source_file, dependency_type, target_file from deps order by source_file, dependency_type, target_file, id limit 100")
_rank = lambda: F.when(F.col("status") == "Processing", 0).when(F.col("status") == "Pending", 1).otherwise(2)
add("o4_custom_rank", lambda m: m.chunks.orderBy(_rank(), F.col("completed_at").desc_nulls_last(), "id").limit(10).select("id", "status"), "select id, status from chunks order by case status when 'Processing' then 0 when 'Pending' then 1 else 2 end, completed_at desc nulls last, id limit 10")
add("o5_copybooks_last", lambda m: m.files.orderBy("is_copybook", "file_name").limit(10).select("id", "file_name"), "select id, file_name from files order by is_copybook, file_name limit 10")
add("o6_feed", lambda m: m.api.orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "ts"), "select id, ts from api order by ts desc, id desc limit 100")
add("o7_conversations", lambda m: m.chat.orderBy(F.desc("conv_id"), F.desc("turn"), "agent").limit(100).select("conv_id", "turn", "agent"), "select conv_id, turn, agent from chat order by conv_id desc, turn desc, agent limit 100")
add("o8_recent_calls", lambda m: m.api.orderBy(F.desc("ts"), F.desc("id")).limit(10).select("id", "agent", "duration_ms"), "select id, agent, duration_ms from api order by ts desc, id desc limit 10")
add("o9_by_chunk_and_name", lambda m: m.sigs.orderBy("run_id", "legacy_name", "seq").limit(200).select("run_id", "legacy_name", "seq"), "select run_id, legacy_name, seq from sigs order by run_id, legacy_name, seq limit 200")

# ---- set operations ----
add("u1_distinct_edges", lambda m: m.deps.select("source_file", "target_file").distinct(), "select distinct source_file, target_file from deps")
add("u2_nodes", lambda m: m.deps.select(F.col("source_file").alias("file")).union(m.deps.select("target_file")).distinct(), "select source_file file from deps union select target_file from deps")
add("u3_activities", lambda m: m.chunks.where("completed_at is not null").select(F.lit("chunk").alias("kind"), "id", F.col("completed_at").alias("ts"), F.col("tokens_used").alias("tokens")).unionByName(m.runs.select(F.lit("run").alias("kind"), "id", F.col("started_at").alias("ts")), allowMissingColumns=True).unionByName(m.api.select(F.lit("api_call").alias("kind"), "id", "ts", "tokens")), "select 'chunk' kind, id, completed_at ts, tokens_used tokens from chunks where completed_at is not null union all select 'run', id, started_at, null from runs union all select 'api_call', id, ts, tokens from api")
add("u4_two_rows_each", lambda m: m.chat.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("request").alias("kind"), F.length("message").alias("n")), F.struct(F.lit("response").alias("kind"), F.col("tokens").cast("int").alias("n")))).alias("e")).select("conv_id", "turn", "e.kind", "e.n"), "select conv_id, turn, 'request' kind, length(message)::int n from chat union all select conv_id, turn, 'response', tokens::int from chat")
add("u5_concatenate", lambda m: m.files.where("not is_copybook").select("id", "file_name").unionByName(m.files.where("is_copybook").select("id", "file_name")), "select id, file_name from files")
add("u6_outbound_inbound", lambda m: m.deps.groupBy("source_file").agg(F.collect_set("target_file").alias("t")).join(m.deps.groupBy(F.col("target_file").alias("source_file")).agg(F.collect_set(F.col("source_file")).alias("s")), "source_file", "left").select("source_file", F.size(F.array_except("t", F.coalesce("s", F.array()))).alias("only_out")), "with o as (select distinct source_file f, target_file t from deps), i as (select distinct target_file f, source_file t from deps) select f source_file, count(*) filter (not exists (select 1 from i where i.f = o.f and i.t = o.t))::int only_out from o group by f")
add("u7_run_ids", lambda m: m.deps.select("run_id").distinct().orderBy(F.desc("run_id")), "select distinct run_id from deps")

# ---- windows ----
_file = lambda: Window.partitionBy("source_file").orderBy("chunk_index")
add("w1_carry_forward", lambda m: m.chunks.withColumn("last_done", F.last(F.when(F.col("status") == "Completed", F.col("chunk_index")), ignorenulls=True).over(_file())).where("last_done is not null").select("id", "last_done"), "select id, last_done from (select id, last_value(case when status = 'Completed' then chunk_index end ignore nulls) over (partition by source_file order by chunk_index) last_done from chunks) where last_done is not null")
add("w2_carry_with_reset", lambda m: m.chunks.withColumn("s", F.sum((F.col("status") == "Failed").cast("int")).over(_file())).withColumn("p", F.last(F.when(F.col("status") == "Completed", F.col("chunk_index")), ignorenulls=True).over(Window.partitionBy("source_file", "s").orderBy("chunk_index"))).select("id", F.col("s").cast("bigint").alias("section"), F.col("p").alias("paragraph")), "with a as (select *, sum((status = 'Failed')::int) over (partition by source_file order by chunk_index)::bigint s from chunks) select id, s section, last_value(case when status = 'Completed' then chunk_index end ignore nulls) over (partition by source_file, s order by chunk_index) paragraph from a")
add("w3_region_end", lambda m: m.chunks.where("status = 'Completed'").withColumn("until", F.coalesce(F.lead("start_line").over(_file()) - 1, F.lit(10_000_000))).select("id", "start_line", "until"), "select id, start_line, coalesce(lead(start_line) over (partition by source_file order by chunk_index) - 1, 10000000) until from chunks where status = 'Completed'")
add("w4_latest_state", lambda m: m.api.groupBy("agent", "model").agg(F.max_by("id", F.struct("ts", -F.col("id"))).alias("id"), F.max("ts").alias("ts")), "select agent, model, min(id) id, max(ts) ts from (select *, max(ts) over (partition by agent, model) t from api) where ts = t group by all")
add("w5_renumber", lambda m: m.chunks.select("source_file", "id", F.concat(F.lit("BR-"), F.row_number().over(_file()).cast("string")).alias("rule")), "select source_file, id, 'BR-' || row_number() over (partition by source_file order by chunk_index) as rule from chunks")
add("w6_first_occurrence", lambda m: P.one_each(m.copies, ["program", "copybook"], "id").select("id", "program", "copybook"), "select min(id) id, program, copybook from copies group by program, copybook")
add("w7_detail_window", lambda m: m.chunks.withColumn("last", F.max("chunk_index").over(Window.partitionBy("source_file"))).groupBy("source_file").agg(F.count_if(F.col("chunk_index") > F.col("last") - 3).alias("full"), F.count_if(F.col("chunk_index") <= F.col("last") - 3).alias("compressed")), "select source_file, least(count(*), 3) \"full\", greatest(count(*) - 3, 0) compressed from chunks group by 1")
add("w7_history", lambda m: history(m.described, m.chunks.groupBy("source_file").agg((F.max("chunk_index") + 1).alias("current"))), "select source_file, chunk_index, '// Chunk ' || chunk_index || ': ' || status || case when n - chunk_index > 3 then ' - ' || len(units) || ' units: ' || array_to_string(units[1:5], ', ') || '...' || chr(10) else chr(10) || array_to_string(list_transform(units, lambda u: '//   - ' || u || chr(10)), '') end entry from (select *, count(*) over (partition by source_file) n from described)")
add("w8_trailing_minute", lambda m: trailing_usage(m.api), "select id, (sum(tokens) over w)::bigint tokens, count(*) over w requests from api window w as (partition by agent order by epoch_us(ts) range between 60000000 preceding and current row)")
