"""Queries of the write algebra and the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import dml as D
from codequarry.operators import graph as G
from codequarry.plans.common import add

# ---- writes ----
_f = ["id", "run_id", "file_name"]
add("d1_replace_run_files", lambda m: D.replace_run(m.files.select(*_f), m.files.where("run_id = 4").select((F.col("id") + 5000000).alias("id"), "run_id", "file_name"), 4), "select id, run_id, file_name from files where run_id <> 4 union all select id + 5000000, run_id, file_name from files where run_id = 4")
add("d2_replace_analyses", lambda m: m.analyses.join(m.files.where("run_id = 4").select(F.col("id").alias("cobol_file_id")), "cobol_file_id", "left_anti").select("id", "cobol_file_id"), "select id, cobol_file_id from analyses where cobol_file_id not in (select id from files where run_id = 4)")


def _upserted(m, columns):
    base = m.chunks.where("id % 3 <> 0").select("source_file", "chunk_index", "status", "start_line", "tokens_used")
    new = m.chunks.where("id % 2 = 0").select("source_file", "chunk_index", F.lit("Pending").alias("status"), (F.col("start_line") + 7).alias("start_line"), F.lit(0).cast("bigint").alias("tokens_used"))
    return D.upsert(base, new, ["source_file", "chunk_index"], columns)


_up = "with b as (select source_file, chunk_index, status, start_line, tokens_used from chunks where id % 3 <> 0), n as (select source_file, chunk_index, 'Pending' status, start_line + 7 start_line, 0::bigint tokens_used from chunks where id % 2 = 0) select source_file, chunk_index, {0} from b full join n using (source_file, chunk_index)"
add("d4_upsert_chunk", lambda m: _upserted(m, ["status", "start_line"]), _up.format("coalesce(n.status, b.status) status, coalesce(n.start_line, b.start_line) start_line, coalesce(b.tokens_used, n.tokens_used) tokens_used"))
add("d5_upsert_result", lambda m: _upserted(m, ["status", "tokens_used"]), _up.format("coalesce(n.status, b.status) status, coalesce(b.start_line, n.start_line) start_line, coalesce(n.tokens_used, b.tokens_used) tokens_used"))
_key = ["run_id", "source_file", "legacy_name"]
add("d6_first_wins", lambda m: D.first_wins(m.sigs, _key, "seq").select(*_key, "seq", "method"), "select run_id, source_file, legacy_name, min(seq) seq, arg_min(method, seq) as method from sigs group by 1, 2, 3")
add("d7_last_wins", lambda m: D.last_wins(m.sigs, _key, "seq").select(*_key, "seq", "method"), "select run_id, source_file, legacy_name, max(seq) seq, arg_max(method, seq) as method from sigs group by 1, 2, 3")
add("d8_patch", lambda m: D.patch(m.runs.select("id", "status", "notes"), m.runs.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "Completed").alias("status"), F.lit("patched").alias("notes")), ["id"]), "select id, case when id % 10 = 0 then 'Completed' else status end status, case when id % 5 = 0 then 'patched' else notes end notes from runs")
add("d9_cancel_stale", lambda m: D.cancel_stale(m.runs, __import__("datetime").datetime(1996, 1, 1)).select("id", "status"), "select id, case when status = 'Running' and started_at < timestamp '1996-01-01' - interval 1 hour then 'Cancelled' else status end status from runs")
add("d10_terminate_running", lambda m: D.update_where(m.runs, F.col("status") == "Running", status=F.lit("Terminated"), notes=F.lit("terminated at start")).select("id", "status", "notes"), "select id, case when status = 'Running' then 'Terminated' else status end status, case when status = 'Running' then 'terminated at start' else notes end notes from runs")
add("d11_cancel_one", lambda m: D.update_where(m.runs, (F.col("id") == 1) & (F.col("status") == "Running"), status=F.lit("Cancelled")).select("id", "status"), "select id, case when id = 1 and status = 'Running' then 'Cancelled' else status end status from runs")
_context = ("chunks", "refs", "sigs", "copies")
add("d12_delete_context", lambda m: D.without_run({"chunks": m.chunks, "refs": m.refs, "sigs": m.sigs.withColumnRenamed("seq", "id"), "copies": m.copies}, 3), " union all ".join(f"select '{t}' t, {'seq' if t == 'sigs' else 'id'} id from {t} where run_id <> 3" for t in _context))
_known = lambda m: m.sigs.where("seq % 3 = 0").groupBy("run_id", "method").agg(F.min("return_type").alias("signature"))
add("d13_resolve_refs", lambda m: D.resolve(m.refs, _known(m)).select("id", "resolved", "actual_signature"), "with k as (select run_id, method, min(return_type) s from sigs where seq % 3 = 0 group by 1, 2) select id, resolved or k.s is not null resolved, case when not resolved and k.s is not null then k.s else actual_signature end actual_signature from refs r left join k on k.run_id = r.run_id and k.method = r.target_method")
add("d14_placeholders", lambda m: D.with_parents(m.files.where("run_id <> 2").select("id", "file_name"), m.analyses), "select id, file_name from files where run_id <> 2 union all select distinct cobol_file_id, 'missing_' || cobol_file_id from analyses where cobol_file_id not in (select id from files where run_id <> 2)")
add("d15_merge_edges", lambda m: D.merged_graph(m.deps)[1], "select run_id, source_file, target_file, arg_max(dependency_type, id) dependency_type from deps group by 1, 2, 3")
add("d16_normalise", lambda m: D.normalised(m.deps.select("id", F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("dependency_type")).alias("context"), (F.col("line_number") - 10).alias("line_number")), "context", "line_number"), "select id, case when id % 3 <> 0 then dependency_type end context, case when line_number > 10 then line_number - 10 end line_number from deps")

# ---- graph ----
add("g0_nodes", lambda m: D.merged_graph(m.deps)[0], "select run_id, source_file file from deps union select run_id, target_file from deps")
add("g0_one_edge_per_pair", lambda m: D.collapse_parallel_edges(m.links), "select source_file, target_file, arg_max(dependency_type, id) dependency_type, arg_max(run_id, id) run_id, count(*) merged from links group by 1, 2")
add("g1_cycles_trails", lambda m: G.cycles(G.plain_edges(m.deps)))
_walk = "with recursive e as (select distinct source_file src, target_file dst from links where source_file <> target_file), s as (select distinct {1} f from e), w as (select f start, f node, 0 d from s union select start, {0}, d + 1 from w join e on e.{1} = w.node where d < 5)"
add("g2_dependencies_pairs", lambda m: G.reach(e := G.plain_edges(m.links), e.select(F.col("src").alias("file"))), _walk.format("e.dst", "src") + " select start, node file, d::int distance from w where d > 0")
add("g2_impact_pairs", lambda m: G.reach(e := G.plain_edges(m.links), e.select(F.col("dst").alias("file")), backward=True), _walk.format("e.src", "dst") + " select start, node file, d::int distance from w where d > 0")
add("g2_min_distance", lambda m: G.nearest(G.reach(e := G.plain_edges(m.links), e.select(F.col("src").alias("file")))), _walk.format("e.dst", "src") + " select start, node file, min(d)::int distance from w where d > 0 group by 1, 2")
_scc = "with recursive e as (select distinct source_file src, target_file dst from links where source_file <> target_file), v as (select src f from e union select dst from e), w as (select f a, f b from v union select a, dst from w join e on e.src = w.b), c as (select x.a file, min(x.b) scc from w x join w y on y.a = x.b and y.b = x.a group by 1), k as (select file, scc, count(*) over (partition by scc) size from c)"
add("g1_strong_components", lambda m: G.strong_components(G.plain_edges(m.links)), _scc + " select file, scc, size from k")
_nodes = lambda m: m.deps.select(F.col("source_file").alias("file")).union(m.deps.select("target_file")).distinct()
_deg = "with e as (select distinct source_file src, target_file dst from deps where source_file <> target_file), n as (select source_file file from deps union select target_file from deps), o as (select src, count(*) c from e group by 1), i as (select dst, count(*) c from e group by 1), g as (select file, coalesce(o.c, 0) outgoing, coalesce(i.c, 0) incoming from n left join o on o.src = file left join i on i.dst = file) "
add("g3_critical_files", lambda m: G.degrees(G.plain_edges(m.deps), _nodes(m)).orderBy(F.desc("total"), "file").limit(20), _deg + "select file, outgoing, incoming, outgoing + incoming total from g order by total desc, file limit 20")
add("g4_edges_with_ends", lambda m: m.deps.join(m.copies.groupBy(F.col("program").alias("source_file")).agg(F.count("*").alias("source_uses")), "source_file", "left").join(m.copies.groupBy(F.col("program").alias("target_file")).agg(F.count("*").alias("target_uses")), "target_file", "left").select("id", "source_file", "target_file", "source_uses", "target_uses"), "with u as (select program, count(*) n from copies group by 1) select id, source_file, target_file, a.n source_uses, b.n target_uses from deps left join u a on a.program = source_file left join u b on b.program = target_file")
add("g5_node_list", lambda m: _nodes(m).withColumn("copybook", F.lower("file").endswith(".cpy")), "select file, lower(file) like '%.cpy' copybook from (select source_file file from deps union select target_file from deps)")
add("g6_undirected_degree", lambda m: G.undirected(G.plain_edges(m.deps)), "with e as (select distinct source_file src, target_file dst from deps where source_file <> target_file), d as (select file, count(*) degree from (select src file from e union all select dst from e) group by 1) select file, degree, case when degree > 5 then 'Critical' when degree > 2 then 'Important' else 'Standard' end importance, 20 + 3 * degree size from d")
add("g7_relational_graph", lambda m: m.deps.select("run_id", "source_file", "target_file", F.coalesce(F.nullif("dependency_type", F.lit("ERROR")), F.lit("DEPENDS_ON")).alias("kind")).distinct(), "select distinct run_id, source_file, target_file, case when dependency_type = 'ERROR' then 'DEPENDS_ON' else dependency_type end kind from deps")
add("g8_files_and_inferred", lambda m: (f := m.chunks.where("run_id < 7").select(F.col("source_file").alias("file")).distinct()).withColumn("inferred", F.lit(False)).union(_nodes(m).join(f, "file", "left_anti").withColumn("inferred", F.lit(True))), "with f as (select distinct source_file file from chunks where run_id < 7) select file, false inferred from f union all select file, true from (select source_file file from deps union select target_file from deps) where file not in (select file from f)")
add("g9_chunk_calls", lambda m: m.refs.join(m.sigs.groupBy("run_id", F.col("method").alias("target_method")).agg(F.min("seq").alias("callee")), ["run_id", "target_method"]).select("id", "callee"), "select id, callee from refs r join (select run_id, method, min(seq) callee from sigs group by 1, 2) k on k.run_id = r.run_id and k.method = r.target_method")
add("o10_dependency_levels", lambda m: G.levels(G.plain_edges(m.deps), _nodes(m)))
