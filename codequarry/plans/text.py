"""Queries of program extraction, chunking, validation and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codequarry.operators import extract as X
from codequarry.plans.common import add, rules

_src = "src as (select * from sources)"
_ln = _src + ", l as (select file, i::int as line, t[i] as text from (select file, string_split(content, chr(10)) t, unnest(generate_series(1, len(string_split(content, chr(10))))) i from src)), c as (select *, upper(text) u from l where substr(text, 7, 1) not in ('*', '/'))"
_trim = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_sql = _src + f", ll as (select file, i::int as line, t[i] as text from (select file, string_split(content, chr(10)) t, unnest(generate_series(1, len(string_split(content, chr(10))))) i from src where file like '%.cbl')), cc as (select file, line, {_trim} s from ll where substr(text, 7, 1) not in ('*', '/') and {_trim} <> ''), q as (select *, count(*) filter (regexp_matches(s, '(?i)EXEC\\s+SQL')) over (partition by file order by line) b from cc), m as (select *, min(line) filter (regexp_matches(s, '(?i)END-EXEC')) over (partition by file, b) e from q), o as (select * from m where b = 0 or line > e)"
_N = "[A-Z0-9][A-Z0-9-]*"


def text(name, f, sql=None):
    """A query over all documents as programs."""
    add(name, lambda m: f(m.sources), "with " + sql if sql else None)


add("t1_line_explode", lambda m: X.lines(m.files.select(F.col("file_name").alias("file"), "content")).select("file", "line", F.md5(F.col("text").cast("binary")).alias("h")), "select file, i::int as line, md5(t[i]) h from (select file_name file, string_split(content, chr(10)) t, unnest(generate_series(1, len(string_split(content, chr(10))))) i from files)")
_name = "[A-Za-z0-9_-]+"
_copy = f"regexp_extract_all(content, '(?i)COPY\\s+({_name})', 1), regexp_extract_all(content, '(?i)INCLUDE\\s+({_name})', 1), regexp_extract_all(content, '(?i)COPY\\s+''({_name})''', 1)"
_copybooks = f"select distinct file, x || '.cpy' copybook from (select file, unnest(list_concat({_copy})) x from src where file like '%.cbl')"
add("t2_copybooks", lambda m: X.copybooks(m.sources, rules(m).patterns("copybook")), "with " + _src + " " + _copybooks)
_call = f"coalesce(nullif(regexp_extract(text, '(?i)CALL\\s+''({_name})''', 1), ''), nullif(regexp_extract(text, '(?i)CALL\\s+\"({_name})\"', 1), ''), nullif(regexp_extract(text, '(?i)CALL\\s+([A-Z][A-Z0-9_-]+)\\s+USING', 1), ''))"
_calls = f"select file, min(line) as line, p || '.cbl' program from (select file, line, {_call} p from l where file like '%.cbl') where p is not null group by file, p"
add("t3_calls", lambda m: X.calls(m.callers, rules(m).patterns("call")), "with " + _ln.replace("from sources", "from callers") + " " + _calls)
_blocks = "select file, b, min(line)::int as line, upper(string_agg(s, ' ' order by line)) s from m where b > 0 and line <= e group by file, b"
_tables = "select distinct file, line, x \"table\" from (select file, line, unnest(list_concat(" + ", ".join(f"regexp_extract_all(s, '{w}\\s+([A-Z0-9_-]+)', 1)" for w in ("FROM", "JOIN", "INTO", "UPDATE", "TABLE", "INCLUDE")) + ")) x from k) where x not in ('DCLGEN', 'OF', 'IN', 'A', 'B', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'WHERE', 'GROUP', 'ORDER', 'BY', 'HAVING')"
text("t4_sql_tables", X.sql_tables, _sql + f", k as ({_blocks}) {_tables}")
_link = "regexp_extract(s, '(?i)LINK\\s+PROGRAM\\s*\\(''([^'']+)''\\)', 1)"
_links = f"select file, line, {_link} program from o where regexp_matches(s, '(?i)EXEC\\s+CICS') and {_link} <> ''"
text("t5_cics_links", X.cics_links, _sql + " " + _links)
_io = " union all ".join(f"select file, line, '{v}' verb, regexp_extract(s, '{p}', 1) \"name\" from o where regexp_matches(s, '{p}')" for v, p in (("OPEN", "(?i)^OPEN\\s+(?:INPUT|OUTPUT|I-O|EXTEND)\\s+([A-Z0-9_-]+)"), ("READ", "(?i)^READ\\s+([A-Z0-9_-]+)"), ("WRITE", "(?i)^WRITE\\s+([A-Z0-9_-]+)"), ("CLOSE", "(?i)^CLOSE\\s+([A-Z0-9_-]+)")))
text("t6_file_io", X.file_io, _sql + " " + _io)
_N2 = "[A-Z0-9][-A-Z0-9]*"
_h = {"div": "(?i)^\\s*(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\\s+DIVISION", "data": "(?i)^\\s*(FILE|WORKING-STORAGE|LINKAGE)\\s+SECTION\\s*\\.", "sec": f"(?i)^\\s*({_N2})\\s+SECTION\\s*\\.", "par": f"(?i)^\\s*({_N2})\\s*\\.\\s*$"}
_heads = f", g as (select file, line, text, case when substr(text, 7, 1) in ('*', '/') then '' else text end t from l), h as (select *, upper(nullif(regexp_extract(t, '{_h['div']}', 1), '')) dv from g), w as (select *, last_value(dv ignore nulls) over (partition by file order by line) inn from h), r as (select *, case when dv is not null then 0 when inn = 'DATA' and regexp_matches(t, '{_h['data']}') then 1 when inn = 'PROCEDURE' and regexp_matches(t, '{_h['sec']}') then 1 when inn = 'PROCEDURE' and regexp_matches(t, '{_h['par']}') then 2 end rk from w), v as (select *, case rk when 0 then dv when 1 then upper(regexp_extract(t, '{_h['sec']}', 1)) when 2 then upper(regexp_extract(t, '{_h['par']}', 1)) end nm, case rk when 0 then nm || '-DIVISION' when 1 then 'SECTION:' || nm when 2 then 'PARAGRAPH:' || nm end id from r)"
_units = ", z as (select *, last_value(case when rk = 0 then id end ignore nulls) over o d, last_value(case when rk <= 1 then rk end ignore nulls) over o sr, last_value(case when rk <= 1 then id end ignore nulls) over o si from v window o as (partition by file order by line)), x as (select file, line, id, rk, nm, case when rk = 0 then 'division' when rk = 2 then 'paragraph' when inn = 'DATA' then 'data section' else 'section' end kind, case when rk = 1 then d when rk = 2 and sr = 1 then si when rk = 2 then d end parent, min(case when rk = 0 then line end) over f n0, min(case when rk <= 1 then line end) over f n1, min(line) over f n2 from z where rk is not null window f as (partition by file order by line rows between 1 following and unbounded following)), u as (select *, coalesce(case rk when 0 then n0 when 1 then n1 else n2 end, 1 << 30) following from x)"
text("t7_units", lambda src: X.units(src).drop("section"), _ln + _heads + _units + " select u.file, id unit, kind, nm \"name\", parent, u.line start_line, max(l.line) end_line, (sum(length(l.text)) + count(*) - 1)::bigint chars, sum(('0x' || md5(l.line || ':' || l.text)[1:12])::bigint)::varchar digest from u join l on l.file = u.file and l.line >= u.line and l.line < u.following group by u.file, id, kind, nm, parent, u.line")
text("t8_variables", X.variables)
_q = "''[^'']*''|\"[^\"]*\""
_items = _ln + f", a as (select file, line, upper(text[8:72]) s from c), b as (select file, line, list_concat(regexp_extract_all(s, '(?:[^''\".]|{_q}|\\.\\S)*(?:\\.(?:\\s|$)|$)')) p from a), p as (select file, line, i, p[i] s, rtrim(p[i]) like '%.' e from (select file, line, p, unnest(generate_series(1, len(p))) i from b) where trim(p[i]) <> ''), n as (select *, coalesce(sum(e::int) over (partition by file order by line, i rows between unbounded preceding and 1 preceding), 0) k from p), t as (select file, k, min(line)::int as line, rtrim(rtrim(string_agg(trim(s), ' ' order by line, i)), '.') t, bool_or(e) e from n group by file, k having regexp_matches(arg_min(s, row(line, i)), '^\\s*\\d{{1,2}}\\s+[A-Z0-9]')), y as (select *, regexp_replace(t, '{_q}', '''''', 'g') o from t where e), d as (select file, line, regexp_extract(o, '^\\s*(\\d{{1,2}})\\s+({_N2})(?:\\s|$)', 1) lv, regexp_extract(o, '^\\s*(\\d{{1,2}})\\s+({_N2})(?:\\s|$)', 2) nm, nullif(regexp_extract(o, '\\sPIC(?:TURE)?\\s+(?:IS\\s+)?(\\S+)', 1), '') pic, nullif(regexp_extract(o, '\\s(COMP(?:UTATIONAL)?(?:-[1-5X])?|BINARY|PACKED-DECIMAL|DISPLAY|INDEX|POINTER)(?:\\s|$)', 1), '') usage, nullif(regexp_extract(t, '\\sVALUES?\\s+(?:IS\\s+|ARE\\s+)?({_q}|\\S+)', 1), '') \"value\", nullif(regexp_extract(o, '\\sOCCURS\\s+(?:\\d+\\s+TO\\s+)?(\\d+)', 1), '')::int occurs, nullif(regexp_extract(o, '\\sDEPENDING\\s+(?:ON\\s+)?({_N2})', 1), '') depending, nullif(regexp_extract(o, '\\sREDEFINES\\s+({_N2})', 1), '') redefines from y), f as (select *, lv::int lev, pic is null and not coalesce(usage in ('COMP-1', 'COMP-2', 'COMPUTATIONAL-1', 'COMPUTATIONAL-2', 'INDEX', 'POINTER'), false) is_group from d where nm <> '') select file, line, lev \"level\", nm \"name\", pic, usage, \"value\", occurs, depending, redefines, is_group from f where lev not in (66, 88) and not (is_group and nm in ('FILLER', 'EXIT', 'STOP', 'END-PROGRAM'))"
text("t8_entries", lambda src: X.entries(src).drop("sentence"), _items)
_para = f"case when not contains(upper(text), 'SECTION') then nullif(regexp_extract(text, '(?i)^\\s{{6}}\\s*({_N2})\\s*\\.\\s*$', 1), '') end"
_edge = lambda k, p: f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda x: {{'c': x, 'k': '{k}'}})"
_cal = _ln + f", pp as (select file, line, text, last_value({_para} ignore nulls) over (partition by file order by line) caller from l), ee as (select file, line, caller, unnest(list_concat({_edge('PERFORM', f'PERFORM\\s+({_N2})')}, {_edge('CALL', 'CALL' + chr(92) + 's+[' + chr(39) * 2 + chr(34) + f']?({_N2})')}, {_edge('GO TO', f'GO\\s+TO\\s+({_N2})')})) e from pp where caller is not null), edges as (select file, line, caller, e.c callee, e.k kind from ee)"
add("t9_call_edges", lambda m: X.call_edges(m.sources, rules(m).edges()), "with " + _cal + " select * from edges")
_ext = f"'\\bCOPY\\s+[''\"]?({_N})[''\"]?(?:\\s+(?:OF|IN)\\s+({_N}))?'"
text("t10_external_copies", X.external_copies, _ln + f" select file, line, regexp_extract(u, {_ext}, 1) \"name\", nullif(regexp_extract(u, {_ext}, 2), '') library from c where regexp_matches(u, {_ext})")
text("t11_paragraph_dependencies", X.paragraph_dependencies, _cal + _heads + " select distinct file, upper(caller) caller, upper(callee) callee from edges where kind = 'PERFORM' and upper(caller) <> upper(callee) and exists (select 1 from v where v.rk = 2 and v.file = edges.file and v.nm = upper(callee))")
add("t12_reply_sections", lambda m: X.reply_sections(m.chat.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("## Rules\n- "), F.replace("message", F.lit(". "), F.lit("\n- "))).alias("text"))).select("id", "section", "pos", F.md5(F.col("item").cast("binary")).alias("h")), "with r as (select conv_id || '/' || turn id, string_split('## Rules' || chr(10) || '- ' || replace(message, '. ', chr(10) || '- '), chr(10)) t from chat), l as (select id, (i - 1)::int pos, t[i] s from (select id, t, unnest(generate_series(1, len(t))) i from r)), q as (select id, pos, s, last_value(nullif(regexp_extract(s, '^#+\\s*(.*?)\\s*$', 1), '') ignore nulls) over (partition by id order by pos) section from l) select id, section, pos, md5(regexp_extract(s, '^\\s*[-*]\\s+(.*?)\\s*$', 1)) h from q where section is not null and regexp_extract(s, '^\\s*[-*]\\s+(.*?)\\s*$', 1) <> ''")
_entries = """with r as (select id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) t from replies),
l as (select id, i, t[i] l, lower(t[i]) w from (select id, t, unnest(generate_series(1, len(t))) i from r)),
h as (select *, starts_with(l, '###') and (contains(w, 'use case') or contains(w, 'user story')) s, starts_with(l, '###') and contains(w, 'feature') f, contains(w, 'business purpose') a, contains(w, 'business rules') or contains(w, 'validations') b from l),
a as (select id, min(i) filter (a) a0, min(i) filter (b) b0 from h group by 1),
e as (select h.id, min(i) filter (i > a0 and not a and (l = '' or contains(w, 'use cases') or contains(w, 'features'))) a1, min(i) filter (i > b0 and not b and starts_with(l, '##')) b1 from h join a using (id) group by 1),
p as (select id, 'purpose' kind, 1 n, string_agg(l, ' ' order by i) as text from h join a using (id) join e using (id) where i > a0 and i < coalesce(a1, 1 << 30) and not a group by 1),
u as (select id, i, trim(ltrim(l, '-• '), ' ') x from h join a using (id) join e using (id) where i > b0 and i < coalesce(b1, 1 << 30) and not b and (starts_with(l, '-') or starts_with(l, '•'))),
v as (select id, i, case when starts_with(x, '**') then trim(replace(x, '**', '')) else x end x from u),
q as (select id, 'rule' kind, row_number() over (partition by id order by i) n, x as text from v where length(x) > 3),
g as (select *, count(*) filter (s) over o sn, count(*) filter (f) over o fn from h window o as (partition by id order by i rows unbounded preceding)),
k as (select *, last_value(case when s then 'title' when starts_with(w, '**trigger:**') then 'role' when starts_with(w, '**description:**') then 'text' when starts_with(w, '**key steps:**') then 'item' end ignore nulls) over (partition by id order by i rows unbounded preceding) part from g where sn > 0),
st as (select id, sn n, i, case when s then 'title' when starts_with(w, '**trigger:**') then 'role' when starts_with(w, '**description:**') then 'text' when starts_with(w, '**key steps:**') or l = '' or starts_with(l, '##') then null when part = 'text' and not starts_with(l, '**') then 'text' when part = 'item' and regexp_matches(l, '^[-0-9]') then 'item' end c,
  case when s then trim(trim(replace(l, '###', ''), ':')) when starts_with(w, '**trigger:**') then trim(replace(l, '**Trigger:**', '')) when starts_with(w, '**description:**') then trim(replace(l, '**Description:**', '')) when part = 'item' then trim(ltrim(l, '-0123456789. ')) else l end x from k),
ft as (select id, fn n, i, case when f then 'title' when starts_with(w, 'description:') then 'text' when starts_with(l, '-') or starts_with(l, '•') then 'item' end c,
  case when f then trim(replace(replace(l, '###', ''), 'Feature:', '')) when starts_with(w, 'description:') then trim(replace(l, 'Description:', '')) else trim(ltrim(l, '-•')) end x from g where fn > 0)
select id, kind, n::bigint n, null title, null as role, text, '' items from (select * from p union all select * from q)
union all select id, 'story', n, max(x) filter (c = 'title'), arg_max(x, i) filter (c = 'role'), coalesce(string_agg(x, ' ' order by i) filter (c = 'text'), ''), coalesce(string_agg(x, '|' order by i) filter (c = 'item'), '') from st where c is not null group by id, n
union all select id, 'feature', n, max(x) filter (c = 'title'), null, coalesce(arg_max(x, i) filter (c = 'text'), ''), coalesce(string_agg(x, '|' order by i) filter (c = 'item'), '') from ft where c is not null group by id, n"""
add("t12_reply_entries", lambda m: X.reply_entries(m.replies).withColumn("items", F.array_join("items", "|")), _entries)
_chunked = lambda df: df.withColumn("file", F.floor(F.col("id") / 4)).withColumn("chunk", F.col("id") % 4)
add("t13_merged_logic", lambda m: X.merged_logic(_chunked(X.reply_entries(m.replies)).drop("id"), _chunked(m.replies)).withColumn("items", F.array_join("items", "|")), "with x as (" + _entries + "), y as (select *, id // 4 as f, id % 4 c from x), ru as (select f, 'rule' kind, text, min(row(c, n)) q from y where kind = 'rule' group by f, text), al as (select f, kind, row(c, n) q, title, role, text, items from y where kind in ('story', 'feature') union all select f, kind, q, null, null, text, '' from ru), pu as (select f, text, min(c) c from y where kind = 'purpose' and trim(text) <> '' and not contains(text, 'ERROR') group by 1, 2), ps as (select f, string_agg(text, ' ' order by c, text) said from pu group by 1), ck as (select id // 4 as f, count(distinct id % 4) k from replies group by 1) select f file, kind, case kind when 'story' then 'US-' when 'feature' then 'F-' else 'BR-' end || row_number() over (partition by f, kind order by q, text) id, title, role, text, items from al union all select f, 'purpose', null, null, null, 'Extracted from ' || k || ' chunks. ' || coalesce(said, ''), '' from ck left join ps using (f)")
add("t13_merged_rules", lambda m: X.merged_rules(m.copies.select(F.col("program").alias("file"), (F.col("id") % 7).alias("chunk"), F.col("id").alias("pos"), F.col("copybook").alias("description"))), "with f as (select program file, copybook description, min(row(id % 7, id)) first_at from copies group by 1, 2) select file, 'BR-' || row_number() over (partition by file order by first_at, description) as rule, description from f")
_MESSAGES = ['Analyzing COBOL file: {f}.cbl', 'Analysis progress: 3 of 9 - {f}.cbl', 'File {f}.cbl has 12 lines', 'Extracting business logic from: {f}.cbl', 'Processing chunk 2 of source {f}.cbl', 'Chunk 1 of 4 done for {f}.cbl', 'Converting {f}.cbl', 'Converting to Java now: {f}.cbl', 'Saving output {f}.java', 'Wrote {f}.cs', 'nothing about {f}.cbl']
_message = "case id % 11 " + " ".join(f"when {i} then '" + x.replace("{f}", "' || {0} || '") + "'" for i, x in enumerate(_MESSAGES)) + " end"
_t14 = (("Analyzing COBOL file:\\s*(.+)$", "Analysis"), ("Analysis progress:.*-\\s*(\\S+[.]cbl)", "Analysis"), ("File\\s+(\\S+[.]cbl)\\s+has", "Analysis"), ("Extracting business logic from:?\\s*(.+)$", "Business Logic"), ("Processing chunk .*source (.+)$", "Chunking"), ("Chunk \\d+ of \\d+.*?(\\S[.]cbl)", "Chunking"), ("Converting\\s+(\\S+[.]cbl)", "Converting"), ("Converting to (?:Java|C#).*(\\S+[.]cbl)", "Converting"), ("Saving.*(\\S+[.](?:java|cs))", "Saving"), ("Wrote\\s+(\\S+[.](?:java|cs))", "Saved"))
add("t14_active_file", lambda m: X.active_files(m.api.select("id", "ts", F.expr(_message.format("agent || model")).alias("line"))), "with l as (select id, ts, " + _message.format("agent || model") + " s from api), h as (" + " union all ".join(f"select id, ts, {i} p, '{stage}' stage, regexp_extract(s, '{p}', 1) file from l" for i, (p, stage) in enumerate(_t14)) + ") select file, arg_max(stage, row(ts, id, -p)) stage, max(ts) ts from h where file <> '' group by file")
text("t15_dependencies", X.dependencies, _sql + _ln.removeprefix(_src) + f", k as ({_blocks}), deps0 as (select file source, program target, 'CALL' kind, line from ({_calls}) union select file, copybook, 'COPY', 0 from ({_copybooks}) union select file, \"table\", 'EXEC SQL', line from ({_tables}) union select file, program, 'EXEC CICS', line from ({_links}) union select file, \"name\", verb, line from ({_io})) select * from deps0")
add("t16_mermaid", lambda m: X.mermaid(m.deps.select(F.col("source_file").alias("source"), F.col("target_file").alias("target"), F.col("dependency_type").alias("kind"))), "with l as (select distinct '    ' || regexp_replace(source_file, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || dependency_type || '| ' || regexp_replace(target_file, '[^A-Za-z0-9]', '_', 'g') as text from deps) select row_number() over (order by text) n, text from l union all select 0, 'graph TD'")
add("t17_merge_analyses", lambda m: m.sigs.groupBy("source_file", "legacy_name").agg(F.min_by("method", "seq").alias("method"), F.min("seq").alias("seq")), "select source_file, legacy_name, arg_min(method, seq) as method, min(seq) seq from sigs group by 1, 2")
