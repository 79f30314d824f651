"""Scalar rules as column expressions: sizes, names, types, scores, dates and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Newlines plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def token_estimates(text: Column) -> dict[str, Column]:
    """Four rules of thumb for tokens from characters (code points)."""
    n = F.length(text)
    return {"chunk": F.floor(n / 4), "general": F.ceil(n / 3.5), "cobol": F.ceil(n / 3.0), "chat": F.floor(n / 4)}


def truncated(text: Column, limit: Column, keep_end: bool = False) -> Column:
    """``text`` cut to ``limit`` characters, at a newline if that keeps over 80 %."""
    if keep_end:
        tail = F.substring(text, F.length(text) - limit + 1, limit)
        at = F.locate("\n", tail)
        return F.when(F.length(text) <= limit, text).otherwise(F.when((at > 0) & (at < limit * 0.2), F.substring(tail, at + 1, limit)).otherwise(tail))
    head = F.substring(text, F.lit(1), limit)
    back = F.locate("\n", F.reverse(head))
    at = F.length(head) - back
    return F.when(F.length(text) <= limit, text).otherwise(F.when((back > 0) & (at > limit * 0.8), F.substring(head, F.lit(1), at)).otherwise(head))


def head_and_tail(text: Column, lines: int) -> Column:
    """The first 40 % and last 50 % of ``lines`` lines of a longer text, a mark between."""
    all_ = F.split(text, "\n")
    head, tail = int(lines * 0.4), int(lines * 0.5)
    cut = F.concat(F.slice(all_, 1, head), F.array(F.lit("... truncated ...")), F.slice(all_, F.size(all_) - tail + 1, tail))
    return F.when(F.size(all_) <= lines, text).otherwise(F.array_join(cut, "\n"))


def request_delay(tokens_per_minute: Column, tokens: Column, least: int) -> Column:
    """Milliseconds between requests at half the rate, from max(500, least) to 120000."""
    raw = (60000.0 / ((tokens_per_minute * 0.5) / tokens)).cast("int")
    return F.least(F.greatest(raw, F.lit(max(500, least))), F.lit(120000))


def _parts(name: Column, seps: str = "-") -> Column:
    return F.filter(F.split(F.lower(name), f"[{seps}]"), lambda x: x != "")


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))


def pascal(name: Column, seps: str = "-") -> Column:
    return F.array_join(F.transform(_parts(name, seps), _capital), "")


def camel(name: Column, seps: str = "-") -> Column:
    p = pascal(name, seps)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1000))


def constant(name: Column) -> Column:
    return F.upper(F.array_join(_parts(name), "_"))


#: Storage prefixes.
PREFIXES = ("WS", "LS", "WK", "LK", "FD", "SD")
#: Reserved words by language.
RESERVED = {
    "csharp": (
        "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if "
        "implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static "
        "string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while"
    ).split(),
    "java": (
        "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native "
        "new null package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false"
    ).split(),
}


def legacy_name(name: Column, kind: str = "field", language: str = "java", prefix: str = "", suffix: str = "") -> Column:
    """A name of one kind (class, method, property, field, parameter, constant, enum) from a legacy one, its storage prefix dropped.

    ``prefix`` and ``suffix`` belong to classes. Reserved words, whatever their case, are escaped: @x in C# and x_ in Java.
    """
    plain = F.regexp_replace(F.upper(F.trim(name)), f"^({'|'.join(PREFIXES)})-", "")
    if kind in ("class", "property", "enum"):
        out = pascal(plain, "_-")
        out = F.concat(F.lit(prefix), out, F.lit(suffix)) if kind == "class" else out
    elif kind == "constant":
        out = F.upper(F.array_join(_parts(plain, "_-"), "_"))
    else:
        out = camel(plain, "_-")
    escaped = F.concat(F.lit("@"), out) if language == "csharp" else F.concat(out, F.lit("_"))
    return F.when(F.trim(name) == "", "").when(F.lower(out).isin(*RESERVED[language]), escaped).otherwise(out)


#: What a name of each kind looks like.
NAME_PATTERNS = {"class": "^[A-Z][a-zA-Z0-9]*$", "interface": "^I[A-Z][a-zA-Z0-9]*$", "method": "^[a-zA-Z][a-zA-Z0-9]*$", "field": "^_?[a-z][a-zA-Z0-9]*$", "constant": "^[A-Z][A-Z0-9_]*$", "parameter": "^[a-z][a-zA-Z0-9]*$"}


def class_name(file: Column) -> Column:
    """Pascal-case name of a file; ConvertedCobolProgram for a blank one, Cobol in front of a digit."""
    stem = F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"\.[^.]*$", "")
    name = pascal(F.regexp_replace(stem, "[^A-Za-z0-9]+", "-"))
    return F.when(name == "", "ConvertedCobolProgram").when(name.rlike("^[0-9]"), F.concat(F.lit("Cobol"), name)).otherwise(name)


#: Ends of a telling class name, and names that tell nothing.
SUFFIXES = (
    "Service Processor Handler Validator Calculator Generator Manager Controller Repository Factory Builder Worker Job Task Runner Executor Parser Formatter Converter Transformer Mapper Reader Writer "
    "Loader Exporter Importer Scheduler Dispatcher Notifier Reporter Analyzer Sanitizer Reconciler Aggregator Batcher Sync"
).split()
GENERIC = "ConvertedCobolProgram CobolProgram Program MainProgram CobolConverter ConvertedProgram LegacyProgram MigratedProgram Application Main Entry Cobol".split()


def valid_identifier(name: Column) -> Column:
    """A letter or underscore, then letters, digits and underscores; null and blank names are none."""
    return F.coalesce(name.rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$"), F.lit(False))


def semantic_name(name: Column) -> Column:
    """A class name that says something: no generic one, and a telling suffix or two capitals in ten characters or more without digits."""
    told = name.rlike(f"({'|'.join(SUFFIXES)})$") | ((F.regexp_count(name, F.lit(r"\p{Lu}")) >= 2) & (F.length(name) >= 10) & ~name.rlike(r"\p{Nd}"))
    return F.coalesce(~F.lower(name).isin(*[g.lower() for g in GENERIC]) & (F.trim(name) != "") & told, F.lit(False))


def digits(pic: Column) -> Column:
    """Digits of a PIC: n for 9(n), 1 for a bare 9."""
    counted = F.aggregate(F.transform(F.regexp_extract_all(pic, F.lit(r"9\((\d+)\)"), F.lit(1)), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)
    return counted + F.length(F.regexp_replace(F.regexp_replace(pic, r"\(\d+\)", "~"), "9~|[^9]", ""))


#: Names of the target types in Java and in C#.
_TYPES = {"java": ("String", "BigDecimal", "boolean"), "csharp": ("string", "decimal", "bool")}


def target_type(legacy: Column, language: str = "java") -> Column:
    """Target type of a COBOL picture, a PL/I or a FORTRAN declaration; a string where nothing fits."""
    string, decimal, boolean = (F.lit(x) for x in _TYPES[language])
    t = F.upper(F.trim(legacy))
    pic = F.trim(F.replace(F.replace(t, F.lit("PIC"), F.lit("")), F.lit("PICTURE"), F.lit("")))
    n = digits(pic)
    whole = F.when(n <= 4, "short").when(n <= 9, "int").when(n <= 18, "long").otherwise(decimal)
    fraction = pic.rlike("[V.]") & (digits(F.element_at(F.split(pic, "[V.]", -1), -1)) > 0)
    cobol = F.when(fraction, decimal).when(pic.contains("9") & ~pic.rlike("[XA]"), whole).when(pic.rlike("[XA]"), string).when(t.rlike("COMP|BINARY"), "int").otherwise(string)
    fixed = t.contains("FIXED")
    pli = F.when(fixed & t.contains("BIN"), "int").when(fixed & t.contains("DEC"), decimal).when(t.contains("FLOAT"), "double").when(t.contains("CHAR"), string).when(t.contains("BIT"), boolean).otherwise(string)
    sized = lambda k: t.contains(f"*{k}") | t.contains(f"({k})")
    fortran = F.when(t.startswith("INTEGER"), F.when(sized(8), "long").when(sized(2), "short").otherwise("int")).when(t.startswith("REAL"), F.when(sized(8), "double").otherwise("float")).when(t.startswith("DOUBLE"), "double").when(t.startswith("LOGICAL"), boolean).otherwise(string)
    return F.when(t.startswith("PIC"), cobol).when(t.rlike("FIXED|FLOAT|CHAR|BIT"), pli).when(t.rlike("^(INTEGER|REAL|DOUBLE|LOGICAL)"), fortran).otherwise(string)


#: Pattern and weight of each sign of complexity.
SIGNS = (
    (r"EXEC\s+SQL", 3), (r"EXEC\s+CICS", 4), (r"EXEC\s+DLI", 4), (r"PERFORM\s+VARYING", 2), (r"PERFORM\s+UNTIL", 1), (r"EVALUATE\s+TRUE", 2), (r"SEARCH\s+ALL", 2), (r"REDEFINES", 2),
    (r"OCCURS\s+\d+.*DEPENDING", 3), (r"OCCURS\s+\d+", 1), (r"COMPUTE\b", 1), (r"INSPECT\b", 1), (r"STRING\b", 1), (r"UNSTRING\b", 2), (r"CALL\s+'[^']+'", 2), (r"ALTER\b", 3),
    (r"GO\s+TO\s+DEPENDING", 3), (r"COPY\b", 1), (r"REPLACE\b", 2),
)


def complexity(text: Column, signs=SIGNS, pic_floor: float = 0.25, level_floor: float = 0.30, copy_bonus: int = 3, exec_bonus: int = 4) -> Column:
    """Weighted signs, and points for dense pictures and levels, for COPY near storage and for embedded SQL; 0 for blank texts."""
    from codequarry.functions.rules import counted

    score, upper = F.lit(0), F.upper(text)
    for pattern, weight in signs:
        score = score + counted(text, upper, pattern) * weight
    lines = F.greatest(meaningful_lines(text), F.lit(1))
    score = score + F.when(upper.contains("PIC") & (F.regexp_count(text, F.lit(r"(?i)\bPIC\b")) / lines > pic_floor), 3).otherwise(0)
    score = score + F.when(F.regexp_count(text, F.lit(r"(?m)^\s*\d{2}\s+")) / lines > level_floor, 2).otherwise(0)
    storage = upper.contains("COPY") & (upper.contains("WORKING-STORAGE") | upper.contains("LINKAGE"))
    score = score + F.when(storage & text.rlike(r"(?i)(WORKING-STORAGE|LINKAGE)\s+SECTION[\s\S]{0,500}COPY\b"), copy_bonus).otherwise(0)
    score = score + F.when(upper.contains("EXEC") & text.rlike(r"(?i)EXEC\s+(SQL|DLI)\b"), exec_bonus).otherwise(0)
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), score).otherwise(0)


def tier(score: Column) -> Column:
    return F.when(score >= 15, "High").when(score >= 5, "Medium").otherwise("Low")


def token_budget(tokens: Column, score: Column, least: int = 32768, most: int = 100_000) -> Column:
    """Input tokens times 1.5, 2.5 or 3.5 by tier, at most ``most``.

    At least ``least`` for texts of the upper tiers and for inputs of half of it; for others at least 4096.
    """
    need = (tokens * F.when(score >= 15, 3.5).when(score >= 5, 2.5).otherwise(1.5)).cast("int")
    floor = F.when((score >= 5) | (tokens >= least // 2), F.lit(least)).otherwise(F.greatest(F.lit(4096), need))
    return F.least(F.greatest(need, floor), F.lit(most))


def fenced(text: Column) -> Column:
    """The block fenced as cobol, else any fenced block, else the whole text."""
    tagged = F.regexp_extract(text, r"(?s)```cobol\n(.*?)```", 1)
    any_ = F.regexp_extract(text, r"(?s)```[a-z]*\n(.*?)```", 1)
    return F.trim(F.when(tagged != "", tagged).when(any_ != "", any_).otherwise(text))


def meaningful_lines(text: Column) -> Column:
    """Lines that are neither blank, nor comments, nor directives of the compiler, by the columns of fixed format."""
    noise = r"(?i)^\s*$|^.{6}\*|^.{0,5}\*>|^.{7}\s*(CBL|PROCESS|EJECT|SKIP1|SKIP2|SKIP3)\b"
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(noise)))


def importance(degree: Column) -> Column:
    return F.when(degree > 5, "Critical").when(degree > 2, "Important").otherwise("Standard")


#: What gives away that a reply was cut short.
CUT_SIGNS = (r"//\s*\.\.\.\s*(remaining|rest|continue|more|etc)", r"//\s*TODO:?\s*(implement|add|complete|remaining)", r"//\s*(omitted|truncated|abbreviated|skipped)", r"\.\.\.\s*$")


def cut_signs(text: Column) -> Column:
    """Number of places where a reply looks cut short."""
    return sum((F.regexp_count(text, F.lit("(?im)" + p)) for p in CUT_SIGNS[1:]), F.regexp_count(text, F.lit("(?im)" + CUT_SIGNS[0])))


def class_declarations(code: Column) -> Column:
    """Distinct names of the classes that some code declares, in order."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?m)^\s*(?:public|protected|private|internal)?\s*(?:static)?\s*(?:sealed|abstract|partial)?\s*class\s+([a-zA-Z0-9_]+)"), F.lit(1)))


def database_sections(analysis: Column) -> Column:
    """Texts of the Markdown sections on embedded SQL and databases, each up to the next heading of that level."""
    return F.transform(F.regexp_extract_all(analysis, F.lit(r"(?is)###\s*(?:Embedded SQL|DB2 Interaction|Database)(.*?)(?=\n###|\z)"), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def stages(totals: DataFrame) -> DataFrame:
    """(run_id, stage, status, progress) of the eight stages of each run.

    ``totals`` has run_id, status, files, programs, analysed, dependencies, chunks, completed, failed and processing.
    Runs without chunks are direct ones: all their files were small.
    """
    c = F.col
    running, done = c("status") == "Running", c("status") == "Completed"
    chunked, direct = c("chunks") > 0, (c("chunks") == 0) & (c("programs") > 0)
    whole = (c("analysed") >= c("programs")) & (c("programs") > 0)
    replaced = chunked & (c("programs") > 0)
    lost = ~chunked & done & (c("analysed") == 0) & (c("programs") > 0)
    all_chunks = chunked & (c("completed") == c("chunks"))
    known = F.when(whole | replaced, "completed").when(lost, "failed")
    going = lambda x: F.when(x, "completed").when(running, "running").otherwise("pending")
    status = {
        "file-discovery": going(c("files") > 0),
        "technical-analysis": known.when(((c("analysed") > 0) & (c("analysed") < c("programs"))) | (running & (c("files") > 0)), "running").otherwise("pending"),
        "business-logic": known.when(c("analysed") > 0, "running").otherwise("pending"),
        "dependency-mapping": going(c("dependencies") > 0),
        "chunking": F.when(direct | all_chunks, "completed").when(chunked, F.when(c("failed") > 0, "failed").otherwise("running")).when(done, "pending").when(c("dependencies") > 0, "running").otherwise("pending"),
        "conversion": F.when(direct, going(done)).when(all_chunks, "completed").when(chunked & (c("failed") > 0), "failed").when(chunked & (c("processing") > 0), "running").otherwise("pending"),
        "assembly": F.when(direct, going(done)).when(done & all_chunks, "completed").when((c("completed") > 0) & ~done, "running").otherwise("pending"),
        "output": F.when(done, "completed").otherwise("pending"),
    }
    share = F.when(c("programs") > 0, F.least(F.lit(90.0), F.bround(c("analysed") * 100.0 / c("programs"), 1).cast("double")))
    progress = F.when(chunked, F.bround(c("completed") * 100.0 / c("chunks"), 1).cast("double")).when(done, 100.0).when((c("analysed") > 0) & (c("programs") > 0), share).when(running, 10.0).otherwise(0.0)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("status")) for k, v in status.items()])).alias("e")
    return totals.select("run_id", each, progress.alias("progress")).select("run_id", "e.stage", "e.status", "progress")


def live_phase(totals: DataFrame) -> DataFrame:
    """(run_id, phase, progress) of each run, from the same totals with ``pending`` chunks too; no phase for a run that neither runs nor is complete."""
    c = F.col
    direct = (c("chunks") == 0) & (c("programs") > 0)
    chunk_phase = F.when(c("processing") > 0, "Converting Chunks").when(c("pending") > 0, "Preparing Chunks").when(c("completed") > 0, "Finalizing").otherwise("Analyzing")
    running = F.when(direct, F.when(c("analysed") < c("programs"), "Analyzing Files").otherwise("Converting")).otherwise(chunk_phase)
    share = lambda a, b: F.coalesce(F.bround(F.try_divide(c(a).cast("double"), c(b).cast("double")) * 100, 1), F.lit(0.0))
    progress = F.when(direct, F.when(c("status") == "Completed", 100.0).otherwise(share("analysed", "programs"))).otherwise(share("completed", "chunks"))
    return totals.select("run_id", F.when(c("status") == "Running", running).when(c("status") == "Completed", "Complete").alias("phase"), progress.alias("progress"))


def backoff(attempt: Column, base: int = 1000, jitter: int = 0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt - 1) + jitter, F.lit(120000.0))


def run_id_of(text: Column) -> Column:
    """Run number named in free text (run 7, run id 7) or in a runs/7/ path; null without one."""
    said = F.regexp_extract(text, r"(?i)\brun\s*(?:id\s*)?(\d+)\b", 1)
    path = F.regexp_extract(text, r"runs/(\d+)/", 1)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(path, F.lit(""))).try_cast("bigint")


def asked_file(text: Column) -> Column:
    """File that a question is about."""
    a = F.regexp_extract(text, r"(?i)(?:what does|explain|describe)\s+([A-Z0-9_-]+\.(?:cbl|cpy))", 1)
    b = F.regexp_extract(text, r"(?i)([A-Z0-9_-]+\.(?:cbl|cpy))", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def clock(line: Column) -> Column:
    """hh:mm:ss of a log line's [..] stamp; dots count as colons, colour codes are dropped; null without one."""
    plain = F.regexp_replace(line, r"\x1b\[[0-9;]*m", "")
    return F.nullif(F.replace(F.regexp_extract(plain, r"\[(\d\d[:.]\d\d[:.]\d\d)(?:\.\d+)?\]", 1), F.lit("."), F.lit(":")), F.lit(""))
