"""Table-valued extraction from COBOL sources.

Sources are (file, content). Line numbers start at 1. Patterns are fixed values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.staging import in_order, numbered

NAME = r"[A-Z0-9][A-Z0-9-]*"


def _so_far():
    """A file's lines up to this one."""
    return Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)


def lines(sources: DataFrame) -> DataFrame:
    """(file, line, text)"""
    return sources.select("file", F.posexplode(F.split("content", "\n")).alias("p", "text")).select("file", (F.col("p") + 1).alias("line"), "text")


def code_lines(sources: DataFrame) -> DataFrame:
    """Lines without those whose raw column 7 marks a comment."""
    return lines(sources).where(~F.substring("text", 7, 1).isin("*", "/"))


def _programs(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("file").endswith(".cbl"))


#: How a program names copybooks, in order.
COPYBOOKS = (r"COPY\s+([A-Za-z0-9_-]+)", r"COPY\s+([A-Za-z0-9_-]+)\.cpy", r"INCLUDE\s+([A-Za-z0-9_-]+)", r"COPY\s+'([A-Za-z0-9_-]+)'")
#: How a line calls a program; the first that fits counts.
CALLS = (r"CALL\s+'([A-Za-z0-9_-]+)'", r'CALL\s+"([A-Za-z0-9_-]+)"', r"CALL\s+([A-Z][A-Z0-9_-]+)\s+USING")


def copybooks(sources: DataFrame, patterns: tuple[str, ...] = COPYBOOKS) -> DataFrame:
    """(file, copybook): the distinct copybooks of each .cbl file, in the case in which they are written."""
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit("(?i)" + p), F.lit(1)) for p in patterns]))
    return _programs(sources).select("file", F.explode(F.array_distinct(found)).alias("c")).select("file", F.concat("c", F.lit(".cpy")).alias("copybook"))


def calls(sources: DataFrame, patterns: tuple[str, ...] = CALLS) -> DataFrame:
    """(file, line, program): the first line of each .cbl file that calls a program; one call a line counts, in comments too."""
    program = F.coalesce(*[F.nullif(F.regexp_extract("text", "(?i)" + p, 1), F.lit("")) for p in patterns])
    hit = lines(_programs(sources)).withColumn("p", program).where("p is not null")
    return hit.groupBy("file", "p").agg(F.min("line").alias("line")).select("file", "line", F.concat("p", F.lit(".cbl")).alias("program"))


def _in_sql(sources: DataFrame) -> DataFrame:
    """Code lines of .cbl files, trimmed, with the EXEC SQL block that they stand in or come after, its last line, and whether they are inside.

    A block ends with the line of its END-EXEC. One that is not closed before the next
    begins, or before the file ends, goes on up to there and has no last line.
    """
    rows = code_lines(_programs(sources)).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    rows = rows.withColumn("block", F.count_if(F.col("text").rlike(r"(?i)EXEC\s+SQL")).over(_so_far()))
    last = F.min(F.when(F.col("text").rlike("(?i)END-EXEC"), F.col("line"))).over(Window.partitionBy("file", "block"))
    rows = rows.withColumn("last", F.when(F.col("block") > 0, last))
    return rows.withColumn("inside", (F.col("block") > 0) & F.coalesce(F.col("line") <= F.col("last"), F.lit(True)))


def sql_blocks(sources: DataFrame) -> DataFrame:
    """(file, block, line, sql): closed EXEC SQL blocks as one text, with their first line."""
    inside = _in_sql(sources).where("inside and last is not null")
    return inside.groupBy("file", "block").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ").alias("sql"))


#: Words before a table's name, and words that are no table.
BEFORE_TABLES = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE", "INCLUDE")
NOT_TABLES = ("DCLGEN", "OF", "IN", "A", "B", "SELECT", "INSERT", "UPDATE", "DELETE", "WHERE", "GROUP", "ORDER", "BY", "HAVING")


def sql_tables(sources: DataFrame, whole_words: bool = False) -> DataFrame:
    """Distinct (file, line, table) of the names after each of ``BEFORE_TABLES``, in upper case; also where such a word ends a longer one, unless ``whole_words``."""
    edge = r"\b" if whole_words else ""
    names = F.flatten(F.array(*[F.regexp_extract_all(F.upper("sql"), F.lit(rf"{edge}{word}\s+([A-Z0-9_-]+)"), F.lit(1)) for word in BEFORE_TABLES]))
    return sql_blocks(sources).select("file", "line", F.explode(F.array_distinct(names)).alias("table")).where(~F.col("table").isin(*NOT_TABLES))


def cics_links(sources: DataFrame) -> DataFrame:
    """(file, line, program) of EXEC CICS LINK on one line, outside EXEC SQL."""
    program = F.regexp_extract("text", r"(?i)LINK\s+PROGRAM\s*\('([^']+)'\)", 1)
    return _in_sql(sources).where(~F.col("inside") & F.col("text").rlike(r"(?i)EXEC\s+CICS")).select("file", "line", program.alias("program")).where("program <> ''")


def file_io(sources: DataFrame) -> DataFrame:
    """(file, line, verb, name): OPEN with a mode, READ, WRITE, CLOSE at the start of a line outside EXEC SQL."""
    pattern = r"(?i)^(?:(OPEN)\s+(?:INPUT|OUTPUT|I-O|EXTEND)|(READ|WRITE|CLOSE))\s+([A-Z0-9_-]+)"
    part = lambda i: F.regexp_extract("text", pattern, i)
    return _in_sql(sources).where(~F.col("inside") & (part(3) != "")).select("file", "line", F.upper(F.concat(part(1), part(2))).alias("verb"), part(3).alias("name"))


_DIVISION = r"(?i)^\s*(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION"
_DATA_SECTION = r"(?i)^\s*(FILE|WORKING-STORAGE|LINKAGE)\s+SECTION\s*\."
_SECTION = r"(?i)^\s*([A-Z0-9][-A-Z0-9]*)\s+SECTION\s*\."
_PARAGRAPH = r"(?i)^\s*([A-Z0-9][-A-Z0-9]*)\s*\.\s*$"
#: Hexadecimal digits of a line's digest that are summed up.
_DIGITS = 12


def _headed(sources: DataFrame, strict_area_a: bool) -> DataFrame:
    """All lines, with rank, kind and name of the unit that a line begins: 0 a division, 1 a section, 2 a paragraph."""
    code = F.when(~F.substring("text", 7, 1).isin("*", "/"), F.col("text"))
    get = lambda pattern: F.nullif(F.regexp_extract(code, pattern, 1), F.lit(""))
    l = lines(sources).withColumn("division", F.upper(get(_DIVISION)))  # noqa: E741
    l = l.withColumn("within", F.last("division", ignorenulls=True).over(_so_far()))  # noqa: E741
    paragraph = get(r"(?i)^ {7,10}([A-Z0-9][-A-Z0-9]*)\s*\.\s*$" if strict_area_a else _PARAGRAPH)
    head = lambda rank, kind, name: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.upper(name).alias("name"))
    found = F.when(F.col("division").isNotNull(), head(0, "division", F.col("division")))
    for of, rank, kind, name in (("DATA", 1, "data section", get(_DATA_SECTION)), ("PROCEDURE", 1, "section", get(_SECTION)), ("PROCEDURE", 2, "paragraph", paragraph)):
        found = found.when((F.col("within") == of) & name.isNotNull(), head(rank, kind, name))
    return l.withColumn("head", found)


def units(sources: DataFrame, strict_area_a: bool = False) -> DataFrame:
    """(file, unit, kind, name, parent, section, start_line, end_line, chars, digest): a program's structure.

    Divisions; the FILE, WORKING-STORAGE and LINKAGE sections of the DATA DIVISION;
    sections and paragraphs of the PROCEDURE DIVISION. A unit goes on to the next one of
    its rank or of a higher one, and its parent is the last one of a higher rank above
    it. ``chars`` is the length of its text, ``digest`` the sum of its lines' digests,
    each with its number, so that no unit's text is gathered. Units of one name in a file
    have the same id. ``strict_area_a`` takes only paragraphs that start in columns 8 to 11.
    """
    l = _headed(sources, strict_area_a)  # noqa: E741
    rank = F.col("head.rank")
    ident = F.concat(F.when(rank == 0, "").when(rank == 1, "SECTION:").otherwise("PARAGRAPH:"), F.col("head.name"), F.when(rank == 0, "-DIVISION").otherwise(""))
    l = l.withColumn("own", F.when(F.col("head").isNotNull(), F.struct(rank.alias("rank"), F.col("line").alias("start"), ident.alias("unit"), F.col("head.kind").alias("kind"), F.col("head.name").alias("name"))))  # noqa: E741
    for r in range(3):  # the last header of this rank or a higher one: the unit of this rank that the line is in, if it is of this rank
        l = l.withColumn(f"in{r}", F.last(F.when(rank <= r, F.col("own")), ignorenulls=True).over(_so_far()))  # noqa: E741
    at = lambda r: F.when(F.col(f"in{r}.rank") == r, F.col(f"in{r}"))
    none = F.lit(None).cast("string")
    parent = (none, at(0)["unit"], F.coalesce(at(1)["unit"], at(0)["unit"]))
    each = F.array(*[F.when(at(r).isNotNull(), F.struct(at(r).alias("u"), parent[r].alias("parent"), (at(1)["name"] if r == 2 else none).alias("section"))) for r in range(3)])
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("line").cast("string"), "text").cast("binary")), 1, _DIGITS), 16, 10).cast("decimal(20,0)")
    rows = l.select("file", "line", F.length("text").alias("size"), digest.alias("digest"), F.explode(F.array_compact(each)).alias("e"))
    names = {"e.u.unit": "unit", "e.u.kind": "kind", "e.u.name": "name", "e.parent": "parent", "e.section": "section", "e.u.start": "start_line"}
    found = rows.groupBy("file", *[F.col(k).alias(v) for k, v in names.items()])
    found = found.agg(F.max("line").alias("end_line"), (F.sum("size") + F.count("*") - 1).alias("chars"), F.sum("digest").cast("decimal(38,0)").cast("string").alias("digest"))
    return found.select("file", *names.values(), "end_line", "chars", "digest")


#: Usages that make an item elementary without a picture.
_ELEMENTARY = ("COMP-1", "COMP-2", "COMPUTATIONAL-1", "COMPUTATIONAL-2", "INDEX", "POINTER")
_QUOTED = r"""'[^']*'|"[^"]*\""""
#: White space as the SQL takes it (without the vertical tab), and the rest.
_S, _T = r"[\t\n\f\r ]", r"[^\t\n\f\r ]"
#: A piece of a line: up to a full stop before white space and outside literals, or to the end. A quote without its fellow is
#: left out, and so is what stands between it and the piece before.
_PIECE = rf"""(?:[^'".]|{_QUOTED}|\.{_T})*(?:\.(?:{_S}|\z)|\z)"""


def entries(sources: DataFrame) -> DataFrame:
    """(file, line, level, name, pic, usage, value, occurs, depending, redefines, is_group): data description entries.

    An entry is a sentence that begins with a level number: columns 8 to 72 of its code
    lines, up to a full stop before white space and outside literals; it may go over
    several lines, and a line may hold several. Its clauses come in any order: ``pic``,
    ``usage``, ``value``, ``occurs`` (the largest number), ``depending``, ``redefines``.
    Levels 66 and 88, and groups named FILLER, EXIT, STOP or END-PROGRAM, are left out. A
    group has neither a picture nor a usage that stands for one.
    """
    area = F.upper(F.substring("text", 8, 65))
    pieces = F.regexp_extract_all(area, F.lit(_PIECE), F.lit(0))
    rows = code_lines(sources).select("file", "line", F.posexplode(pieces).alias("p", "piece")).where(F.trim("piece") != "")
    order = Window.partitionBy("file").orderBy("line", "p")
    rows = rows.withColumn("closed", F.rtrim("piece").endswith("."))
    rows = rows.withColumn("sentence", F.coalesce(F.sum(F.col("closed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.first("piece").over(Window.partitionBy("file", "sentence").orderBy("line", "p").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("first", first).where(F.col("first").rlike(rf"^{_S}*\d{{1,2}}{_S}+[A-Z0-9]"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "p", "piece"))), lambda x: F.trim(x["piece"])), " ")
    whole = rows.groupBy("file", "sentence").agg(F.min("line").alias("line"), joined.alias("t"), F.bool_or("closed").alias("closed")).where("closed")
    t = F.rtrim(F.rtrim("t"), F.lit("."))
    whole = whole.select("file", "line", "sentence", t.alias("t"), F.regexp_replace(t, _QUOTED, "''").alias("bare"))
    clause = lambda column, pattern: F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
    head = rf"^{_S}*(\d{{1,2}}){_S}+([A-Z0-9][-A-Z0-9]*)(?={_S}|\z)"
    out = whole.select(
        "file", "line", "sentence", F.regexp_extract("bare", head, 1).cast("int").alias("level"), F.regexp_extract("bare", head, 2).alias("name"),
        clause("bare", rf"{_S}PIC(?:TURE)?{_S}+(?:IS{_S}+)?({_T}+)").alias("pic"),
        clause("bare", rf"{_S}(COMP(?:UTATIONAL)?(?:-[1-5X])?|BINARY|PACKED-DECIMAL|DISPLAY|INDEX|POINTER)(?={_S}|\z)").alias("usage"),
        clause("t", rf"{_S}VALUES?{_S}+(?:IS{_S}+|ARE{_S}+)?({_QUOTED}|{_T}+)").alias("value"),
        clause("bare", rf"{_S}OCCURS{_S}+(?:\d+{_S}+TO{_S}+)?(\d+)").cast("int").alias("occurs"),
        clause("bare", rf"{_S}DEPENDING{_S}+(?:ON{_S}+)?([A-Z0-9][-A-Z0-9]*)").alias("depending"),
        clause("bare", rf"{_S}REDEFINES{_S}+([A-Z0-9][-A-Z0-9]*)").alias("redefines"),
    ).where("name <> '' and level not in (66, 88)")
    group = F.col("pic").isNull() & ~F.coalesce(F.col("usage").isin(*_ELEMENTARY), F.lit(False))
    return out.withColumn("is_group", group).where("not (is_group and name in ('FILLER', 'EXIT', 'STOP', 'END-PROGRAM'))")


def variables(sources: DataFrame) -> DataFrame:
    """``entries`` with ``parent``: the nearest group of a lower level above; the level stack is state in order by file."""
    rows = entries(sources)

    def step(stack: list, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for level, name, is_group in zip(pdf["level"], pdf["name"], pdf["is_group"]):
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append(stack[-1][1] if stack else None)
            if is_group:
                stack.append((level, name))
        return pdf.assign(parent=out, occurs=pdf["occurs"].astype("Int32"))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return in_order(rows, "file", ["sentence"], lambda _: [], step, lambda _: None, kinds + ", parent string").drop("sentence")


#: How a paragraph refers to others.
EDGES = (("PERFORM", r"PERFORM\s+([A-Z0-9][-A-Z0-9]*)"), ("CALL", r"""CALL\s+['"]?([A-Z0-9][-A-Z0-9]*)['"]?"""), ("GO TO", r"GO\s+TO\s+([A-Z0-9][-A-Z0-9]*)"))


def call_edges(sources: DataFrame, edges: tuple[tuple[str, str], ...] = EDGES) -> DataFrame:
    """(file, line, caller, callee, kind) of PERFORM, CALL and GO TO by the paragraph above, in the case in which they are written.

    None before the first paragraph, which may stand in any division. All lines count,
    and what follows PERFORM is taken as it stands, UNTIL and VARYING too.
    """
    paragraph = F.when(~F.upper("text").contains("SECTION"), F.nullif(F.regexp_extract("text", r"(?i)^\s{6}\s*([A-Z0-9][-A-Z0-9]*)\s*\.\s*$", 1), F.lit("")))
    l = lines(sources).withColumn("caller", F.last(paragraph, ignorenulls=True).over(_so_far())).where("caller is not null")  # noqa: E741
    each = F.flatten(F.array(*[_tagged(F.col("text"), "(?i)" + p, k) for k, p in edges]))
    return l.select("file", "line", "caller", F.explode(each).alias("e")).select("file", "line", "caller", "e.callee", "e.kind")


def _tagged(text, pattern: str, kind: str):
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.struct(x.alias("callee"), F.lit(kind).alias("kind")))


def external_copies(sources: DataFrame) -> DataFrame:
    """(file, line, name, library) of COPY name [OF|IN library]; a closing full stop is no part of a name."""
    pattern = rf"\bCOPY\s+['\"]?({NAME})['\"]?(?:\s+(?:OF|IN)\s+({NAME}))?"
    up = F.upper("text")
    return code_lines(sources).select("file", "line", F.regexp_extract(up, pattern, 1).alias("name"), F.nullif(F.regexp_extract(up, pattern, 2), F.lit("")).alias("library")).where("name <> ''")


def paragraph_dependencies(sources: DataFrame) -> DataFrame:
    """Distinct (file, caller, callee), in upper case: PERFORMs of another paragraph of the file's PROCEDURE DIVISION."""
    known = units(sources).where("kind = 'paragraph'").select("file", F.col("name").alias("callee")).distinct()
    performed = call_edges(sources).where("kind = 'PERFORM'").select("file", F.upper("caller").alias("caller"), F.upper("callee").alias("callee"))
    return performed.where("caller <> callee").distinct().join(known, ["file", "callee"], "left_semi").select("file", "caller", "callee")


def dependencies(sources: DataFrame) -> DataFrame:
    """Distinct (source, target, kind, line) of calls, copybooks, SQL tables, CICS links and file I/O."""
    parts = [
        calls(sources).select(F.col("file").alias("source"), F.col("program").alias("target"), F.lit("CALL").alias("kind"), "line"),
        copybooks(sources).select(F.col("file").alias("source"), F.col("copybook").alias("target"), F.lit("COPY").alias("kind"), F.lit(0).alias("line")),
        sql_tables(sources).select(F.col("file").alias("source"), F.col("table").alias("target"), F.lit("EXEC SQL").alias("kind"), "line"),
        cics_links(sources).select(F.col("file").alias("source"), F.col("program").alias("target"), F.lit("EXEC CICS").alias("kind"), "line"),
        file_io(sources).select(F.col("file").alias("source"), F.col("name").alias("target"), F.col("verb").alias("kind"), "line"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["source", "target", "kind", "line"])


def mermaid(edges: DataFrame) -> DataFrame:
    """(n, text): the lines of the edges (source, target, kind) as a flowchart, in order from 0."""
    ident = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    line = F.concat(F.lit("    "), ident(F.col("source")), F.lit(" -->|"), F.col("kind"), F.lit("| "), ident(F.col("target")))
    body = numbered(edges.select(line.alias("text")).distinct(), "text").select("n", "text")
    return edges.sparkSession.createDataFrame([(0, "graph TD")], "n bigint, text string").union(body)


#: What a log line says of a file and the stage that it is in.
ACTIVE = (
    (r"Analyzing COBOL file:\s*(.+)$", "Analysis"),
    (r"Analysis progress:.*-\s*(\S+\.cbl)", "Analysis"),
    (r"File\s+(\S+\.cbl)\s+has", "Analysis"),
    (r"Extracting business logic from:?\s*(.+)$", "Business Logic"),
    (r"Processing chunk .*source (.+)$", "Chunking"),
    (r"Chunk \d+ of \d+.*(\S+\.cbl)", "Chunking"),
    (r"Converting\s+(\S+\.cbl)", "Converting"),
    (r"Converting to (?:Java|C#).*(\S+\.cbl)", "Converting"),
    (r"Saving.*(\S+\.(?:java|cs))", "Saving"),
    (r"Wrote\s+(\S+\.(?:java|cs))", "Saved"),
)


def active_files(log: DataFrame) -> DataFrame:
    """(file, stage, ts): the last stage of each file that log lines (id, ts, line) name; of equal times the last line and its first pattern."""
    hits = F.array(*[F.struct(F.lit(-i).alias("p"), F.lit(stage).alias("stage"), F.regexp_extract("line", p, 1).alias("file")) for i, (p, stage) in enumerate(ACTIVE)])
    found = log.select("id", "ts", F.explode(hits).alias("h")).where("h.file <> ''")
    return found.groupBy(F.col("h.file").alias("file")).agg(F.max_by("h.stage", F.struct("ts", "id", "h.p")).alias("stage"), F.max("ts").alias("ts"))


def reply_sections(replies: DataFrame) -> DataFrame:
    """(id, section, pos, item): list items of a Markdown reply under the heading above them."""
    l = replies.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "l"))  # noqa: E741
    head = F.nullif(F.regexp_extract("l", r"^#+\s*(.*?)\s*$", 1), F.lit(""))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("section", F.last(head, ignorenulls=True).over(w)).withColumn("item", F.regexp_extract("l", r"^\s*[-*]\s+(.*?)\s*$", 1))  # noqa: E741
    return l.where("item <> '' and section is not null").select("id", "section", "pos", "item")


def reply_entries(replies: DataFrame) -> DataFrame:
    """(id, kind, n, title, role, text, items): purpose, stories, features and rules of Markdown replies (id, text).

    purpose: the lines after the first that names the Business Purpose, up to an empty
    line or one that names use cases or features. story: a ### heading of a use case or
    user story, with its trigger (role), description (text) and key steps (items).
    feature: a ### heading that names a feature, with its last description and its list
    items. rule: the list items of over three characters after the first heading of
    business rules or validations, up to the next other ## heading. n counts each kind
    from 1. Stories and features last to the next heading of their kind, whatever other
    headings stand between, so kinds share lines. A null or empty text, or one
    without headings, gives no row.
    """
    has = lambda *names: F.lower("l").rlike("|".join(names))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = lambda mark: trim(F.replace("l", F.lit(mark), F.lit("")))
    starts = lambda mark: F.lower("l").startswith(mark.lower())
    upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = replies.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "l")).withColumn("l", trim("l"))  # noqa: E741
    story, feature = F.col("l").startswith("###") & has("use case", "user story"), F.col("l").startswith("###") & has("feature")
    aim, rules = has("business purpose"), has("business rules", "validations")
    part = F.when(story, "title").when(starts("**Trigger:**"), "role").when(starts("**Description:**"), "text").when(starts("**Key Steps:**"), "item")
    l = (
        l.withColumn("story", F.count_if(story).over(upto)).withColumn("feature", F.count_if(feature).over(upto)).withColumn("part", F.last(F.when(F.col("story") > 0, part), True).over(upto))
        .withColumn("in_aim", F.count_if(aim).over(upto) > 0).withColumn("aim_over", F.count_if(F.col("in_aim") & ~aim & ((F.col("l") == "") | has("use cases", "features"))).over(upto) > 0)
        .withColumn("in_rules", F.count_if(rules).over(upto) > 0).withColumn("rules_over", F.count_if(F.col("in_rules") & ~rules & F.col("l").startswith("##")).over(upto) > 0)
    )
    listed = F.col("l").rlike("^[-\u2022]")
    rule = trim(F.regexp_replace("l", "^[-\u2022 ]+", ""))
    rule = F.when(rule.startswith("**"), trim(F.replace(rule, F.lit("**"), F.lit("")))).otherwise(rule)
    l = l.withColumn("rule", F.when(F.col("in_rules") & ~F.col("rules_over") & ~rules & listed & (F.length(rule) > 3), rule))  # noqa: E741
    l = l.withColumn("rule_n", F.count("rule").over(upto))  # noqa: E741
    entry = lambda kind, n, field, value: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), field.alias("field"), value.alias("value"))
    plain = (F.col("l") != "") & ~F.col("l").startswith("##")
    said = lambda f, v: F.struct(F.lit(f).alias("f"), v.alias("v"))
    told = (
        F.when(story, said("title", trim(F.regexp_replace(F.replace("l", F.lit("###"), F.lit("")), "^:+|:+$", ""))))
        .when(starts("**Trigger:**"), said("role", after("**Trigger:**")))
        .when(starts("**Description:**"), said("text", after("**Description:**")))
        .when(starts("**Key Steps:**"), F.lit(None))
        .when(plain & (F.col("part") == "text") & ~F.col("l").startswith("**"), said("text", F.col("l")))
        .when(plain & (F.col("part") == "item") & F.col("l").rlike(r"^[-0-9]"), said("item", trim(F.regexp_replace("l", r"^[-0-9. ]+", ""))))
    )
    shown = (
        F.when(feature, said("title", trim(F.replace(F.replace("l", F.lit("###"), F.lit("")), F.lit("Feature:"), F.lit("")))))
        .when(starts("Description:"), said("last", after("Description:")))
        .when(listed, said("item", trim(F.regexp_replace("l", "^[-\u2022]+", ""))))
    )
    l = l.withColumn("told", F.when(F.col("story") > 0, told)).withColumn("shown", F.when(F.col("feature") > 0, shown))  # noqa: E741
    found = F.array(
        F.when(F.col("in_aim") & ~F.col("aim_over") & ~aim, entry("purpose", F.lit(1), F.lit("text"), F.col("l"))),
        F.when(F.col("told").isNotNull(), entry("story", F.col("story"), F.col("told.f"), F.col("told.v"))),
        F.when(F.col("shown").isNotNull(), entry("feature", F.col("feature"), F.col("shown.f"), F.col("shown.v"))),
        F.when(F.col("rule").isNotNull(), entry("rule", F.col("rule_n"), F.lit("text"), F.col("rule"))),
    )
    e = l.select("id", "pos", F.explode(F.array_compact(found)).alias("e")).select("id", "pos", "e.*")
    one = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("pos")))
    many = lambda f: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("pos", "value")))), lambda x: x["value"])
    text = F.coalesce(one("last"), F.array_join(many("text"), " "))
    return e.groupBy("id", "kind", "n").agg(one("title").alias("title"), one("role").alias("role"), text.alias("text"), many("item").alias("items"))


def merged_rules(rules: DataFrame) -> DataFrame:
    """(file, chunk, pos, description) merged by description, first occurrence kept, renumbered BR-1 and on."""
    first = rules.groupBy("file", "description").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy("file").orderBy("at", "description"))
    return first.select("file", F.concat(F.lit("BR-"), n.cast("string")).alias("rule"), "description")


def merged_logic(entries: DataFrame, replies: DataFrame) -> DataFrame:
    """(file, kind, id, title, role, text, items): what the chunks of each file say, merged.

    ``entries`` are ``reply_entries`` with (file, chunk), ``replies`` all (file, chunk).
    Stories and features follow each other by chunk and n and are numbered US-1 and F-1 on;
    of rules of one text the first stays, numbered BR-1 on. A file's one purpose names
    the number of its chunks and joins their distinct purposes, without blank ones and those
    that hold ERROR, in order.
    """
    order = F.struct("chunk", "n")
    rules = entries.where("kind = 'rule'").groupBy("file", "kind", "text").agg(F.min(order).alias("at")).select("file", "kind", "at", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("role"), "text", F.array().cast("array<string>").alias("items"))
    told = entries.where("kind in ('story', 'feature')").select("file", "kind", order.alias("at"), "title", "role", "text", "items")
    mark = F.when(F.col("kind") == "story", "US-").when(F.col("kind") == "feature", "F-").otherwise("BR-")
    n = F.row_number().over(Window.partitionBy("file", "kind").orderBy("at", "text"))
    out = told.union(rules).select("file", "kind", F.concat(mark, n.cast("string")).alias("id"), "title", "role", "text", "items")
    said = entries.where("kind = 'purpose' and trim(text) <> '' and not contains(text, 'ERROR')").groupBy("file", "text").agg(F.min("chunk").alias("chunk"))
    said = said.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), " ").alias("said"))
    chunks = replies.groupBy("file").agg(F.countDistinct("chunk").alias("chunks"))
    aim = F.concat(F.lit("Extracted from "), F.col("chunks").cast("string"), F.lit(" chunks. "), F.coalesce("said", F.lit("")))
    none = F.lit(None).cast("string")
    return out.union(chunks.join(said, "file", "left").select("file", F.lit("purpose"), none, none, none, aim, F.array().cast("array<string>")))
