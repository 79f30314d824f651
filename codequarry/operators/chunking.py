"""Chunks of sources: size routing, line windows, semantic packing, splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.staging import in_order, stored

#: Defaults of the settings.
MAX_LINES, OVERLAP, MAX_TOKENS = 1500, 300, 28000
BIG_CHARS, BIG_LINES = 150_000, 3000


def routed(files: DataFrame, max_lines: int = MAX_LINES, big_chars: int = BIG_CHARS, big_lines: int = BIG_LINES) -> DataFrame:
    """(id, lines, large, estimated): large by characters or lines; chunks by lines."""
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    return files.select("id", lines.alias("lines"), ((F.length("content") > big_chars) | (lines > big_lines)).alias("large"), F.ceil(lines / max_lines).alias("estimated"))


def windows(sized: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk, total_chunks, start_line, end_line) of (id, lines): windows of ``max_lines`` that share ``overlap``."""
    if not 0 <= overlap < max_lines:
        raise ValueError("overlap must be less than the window")
    step = max_lines - overlap
    n = F.greatest(F.lit(1), F.ceil(F.col("lines") / step)).cast("int")
    out = sized.select("id", "lines", n.alias("total_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).withColumn("start_line", F.col("chunk") * step + 1)
    return out.select("id", "chunk", "total_chunks", "start_line", F.least(F.col("start_line") + max_lines - 1, F.col("lines")).alias("end_line"))


def overlap_text(content: Column, start: Column, overlap: int) -> Column:
    """The lines just before ``start``."""
    lines = F.split(content, "\n")
    first = F.greatest(start - overlap, F.lit(1))
    return F.when(start > 1, F.array_join(F.slice(lines, first, start - first), "\n"))


#: Rank of the units after which a full chunk is best cut.
_RANK = {"division": 3, "section": 2, "paragraph": 1}


class _Packing:
    """Units held for the chunk that is being filled, and those whose chunk is known."""

    def __init__(self, max_lines: int, max_tokens: int) -> None:
        self.max_lines, self.max_tokens = max_lines, max_tokens
        self.held: list[tuple] = []  # unit, lines, tokens, rank
        self.lines = self.tokens = self.chunk = 0
        self.done: list[tuple] = []

    def close(self, count: int) -> None:
        """The first ``count`` held units make a chunk; the rest is carried over."""
        self.done += [(*u[0], self.chunk) for u in self.held[:count]]
        self.held = self.held[count:]
        self.chunk += 1
        self.lines, self.tokens = sum(u[1] for u in self.held), sum(u[2] for u in self.held)

    def add(self, unit: tuple, lines: int, tokens: int, kind: str) -> None:
        over, first = self.tokens + tokens > self.max_tokens or self.lines + lines > self.max_lines, not self.held
        if over and not first:
            self.close(max(range(len(self.held)), key=lambda i: (self.held[i][3], i)) + 1)
        self.held.append((unit, lines, tokens, _RANK.get(kind, 0)))
        self.lines, self.tokens = self.lines + lines, self.tokens + tokens
        if over and first:
            self.close(1)


def packed(units: DataFrame, max_lines: int = MAX_LINES, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(file, pos, kind, lines, tokens) -> the units with their chunk.

    Units are added in order until one more would exceed a limit. The chunk then
    ends with its last division, else its last section, else its last paragraph,
    else its last unit; what follows that unit is carried over to the next chunk,
    together with the new one. A unit too long for an empty chunk is a chunk of its own. State in order by file, in bounded memory.
    """
    names = ["file", "pos", "kind", "lines", "tokens"]

    def rows(p: _Packing) -> pd.DataFrame | None:
        out, p.done = p.done, []
        return pd.DataFrame(out, columns=[*names, "chunk"]) if out else None

    def step(p: _Packing, pdf: pd.DataFrame) -> pd.DataFrame | None:
        for unit in pdf[names].itertuples(index=False, name=None):
            p.add(unit, unit[3], unit[4], unit[2])
        return rows(p)

    def end(p: _Packing) -> pd.DataFrame | None:
        p.close(len(p.held))
        return rows(p)

    return in_order(units.select(*names), "file", ["pos"], lambda _: _Packing(max_lines, max_tokens), step, end, units.select(*names).schema.add("chunk", T.IntegerType()).simpleString().removeprefix("struct<").removesuffix(">"))


def overlaps(chunks: DataFrame, units: DataFrame, width: int = 1000) -> DataFrame:
    """(chunk, unit) of the same file whose lines overlap; both are (id, source_file, start_line, end_line).

    They meet in buckets of ``width`` lines, and count in the first one that both reach.
    """
    bucket = F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width)))
    c = chunks.select("source_file", F.col("id").alias("chunk"), F.col("start_line").alias("a"), F.col("end_line").alias("b"), bucket.alias("bucket"))
    u = units.select("source_file", F.col("id").alias("unit"), F.col("start_line").alias("x"), F.col("end_line").alias("y"), bucket.alias("bucket"))
    first = F.floor(F.greatest("a", "x") / width)
    return c.join(u, ["source_file", "bucket"]).where((F.col("x") <= F.col("b")) & (F.col("y") >= F.col("a")) & (F.col("bucket") == first)).select("chunk", "unit")


def nearest_lower(rows: DataFrame) -> DataFrame:
    """(file, pos, level) with ``parent``: the nearest earlier place of a lower level; null without one. State in order by file."""

    def step(stack: list, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pos, level in zip(pdf["pos"].tolist(), pdf["level"].tolist()):
            while stack and stack[-1][1] >= level:
                stack.pop()
            out.append(stack[-1][0] if stack else None)
            stack.append((pos, level))
        return pdf.assign(parent=pd.array(out, dtype="Int64"))[["file", "pos", "level", "parent"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return in_order(rows.select("file", "pos", "level"), "file", ["pos"], lambda _: [], step, lambda _: None, f"file {kinds['file']}, pos {kinds['pos']}, level {kinds['level']}, parent bigint")


def policy(files: DataFrame, units: DataFrame, max_lines: int = MAX_LINES, enabled: bool = True) -> DataFrame:
    """(id, way): one chunk if chunking is off or the file is small, windows without units or with one too long, else semantic."""
    u = units.groupBy("id").agg(F.max("lines").alias("longest"))
    way = F.when(F.lit(not enabled) | (F.col("lines") <= max_lines), "single").when(F.col("longest").isNull() | (F.col("longest") > max_lines), "windows").otherwise("semantic")
    return files.join(u, "id", "left").select("id", way.alias("way"))


def split_point(lines: DataFrame, reach: float = 0.25) -> DataFrame:
    """(file, at): where a file of over 20 lines is halved.

    Within 25 % of the middle and clear of the first and last ten lines, the
    nearest DIVISION, else SECTION, else paragraph; the middle without any.
    """
    n = lines.groupBy("file").agg(F.max("line").alias("n")).withColumn("mid", F.floor(F.col("n") / 2).cast("int"))
    up = F.upper("text")
    rank = F.when(up.rlike(r"\bDIVISION\b"), 0).when(up.rlike(r"\bSECTION\b"), 1).when(up.rlike(r"^\s{7}[A-Z0-9-]+\.\s*$"), 2)
    near = lines.join(n, "file").withColumn("rank", rank).withColumn("far", F.abs(F.col("line") - F.col("mid")))
    near = near.where((F.col("far") <= F.col("n") * reach) & (F.col("line") > 10) & (F.col("line") <= F.col("n") - 10) & F.col("rank").isNotNull())
    best = near.groupBy("file").agg(F.min_by("line", F.struct("rank", "far", "line")).alias("found"))
    return n.join(best, "file", "left").select("file", F.coalesce("found", "mid").alias("at"))


def plan_summary(chunks: DataFrame, max_lines: int) -> DataFrame:
    """(id, chunks, longest, valid) of chunk rows: at least one, none over the limit."""
    size = F.col("end_line") - F.col("start_line") + 1
    return chunks.groupBy("id").agg(F.count("*").alias("chunks"), F.max(size).alias("longest"), (F.max(size) <= max_lines).alias("valid"))


def checked(summary: DataFrame, files: DataFrame, max_lines: int) -> DataFrame:
    """``plan_summary`` rows of all ``files`` (id); the job fails at a file without a chunk or with one over the limit."""
    both = files.select("id").join(summary, "id", "left")
    error = F.concat(F.lit("no valid chunks within "), F.lit(str(max_lines)), F.lit(" lines: file "), F.col("id").cast("string"))
    return both.withColumn("valid", F.when(F.coalesce("valid", F.lit(False)), True).otherwise(F.raise_error(error).cast("boolean")))


#: The history's heading, what an entry of the context counts in tokens, chunks shown in full.
HISTORY_HEADING = "// Compressed history from previous chunks:\n"
SIGNATURE_TOKENS, MAPPING_TOKENS, REFERENCE_TOKENS, FULL_WINDOW = 20, 30, 40, 3


def _history_entries() -> tuple[Column, Column]:
    """What a chunk (chunk_index, status, units) adds to the history of later ones: in full, and compressed to a count and five names."""
    head = F.concat(F.lit("// Chunk "), F.col("chunk_index").cast("string"), F.lit(": "), F.col("status"))
    full = F.concat(head, F.lit("\n"), F.array_join(F.transform("units", lambda u: F.concat(F.lit("//   - "), u, F.lit("\n"))), ""))
    short = F.concat(head, F.lit(" - "), F.size("units").cast("string"), F.lit(" units: "), F.array_join(F.slice("units", 1, 5), ", "), F.lit("...\n"))
    return full, short


def history(chunks: DataFrame, current: DataFrame, window: int = FULL_WINDOW) -> DataFrame:
    """(source_file, chunk_index, entry): the earlier chunks as chunk ``current`` (source_file, current) of each file sees them.

    The last ``window`` are in full, older ones compressed. A row a chunk, so a
    file's history is never one value; the heading is the caller's.
    """
    full, short = _history_entries()
    before = chunks.join(current, "source_file").where(F.col("chunk_index") < F.col("current"))
    return before.select("source_file", "chunk_index", F.when(F.col("chunk_index") < F.col("current") - window, short).otherwise(full).alias("entry"))


def context(chunks: DataFrame, signatures: DataFrame, mappings: DataFrame, refs: DataFrame, window: int = FULL_WINDOW) -> DataFrame:
    """(source_file, chunk_index, signatures, mappings, open_refs, tokens): what the strictly earlier chunks have left.

    ``chunks`` are (source_file, chunk_index, start_line, end_line, status, units),
    one row each; signatures (source_file, chunk_index, target_signature), mappings
    and pending refs (source_file, chunk_index) count for all later chunks. tokens
    is the estimate for the chunk's context: its summary, its signatures, mappings
    and references, and its history with the last ``window`` chunks in full.
    """
    from pyspark.sql import Window

    keys = ["source_file", "chunk_index"]
    s = signatures.groupBy(*keys).agg(F.count("*").alias("s"), F.sum(F.floor(F.length("target_signature") / 4) + SIGNATURE_TOKENS).alias("st"))
    m = mappings.groupBy(*keys).agg(F.count("*").alias("m"))
    r = refs.groupBy(*keys).agg(F.count("*").alias("r"))
    full, short = _history_entries()
    both = chunks.withColumn("f", F.length(full)).withColumn("c", F.length(short)).join(s, keys, "left").join(m, keys, "left").join(r, keys, "left")
    file = Window.partitionBy("source_file")
    by = file.orderBy("chunk_index")
    past = lambda c, a, b: F.coalesce(F.sum(c).over(by.rangeBetween(a, b)), F.lit(0))
    start = Window.unboundedPreceding
    both = both.withColumn("n", F.count("*").over(file))
    for name, of in (("signatures", "s"), ("sig_tokens", "st"), ("mappings", "m"), ("open_refs", "r")):
        both = both.withColumn(name, past(of, start, -1))
    both = both.withColumn("history", past("c", start, -window - 1) + past("f", -window, -1) + F.when(F.col("chunk_index") > 0, len(HISTORY_HEADING)).otherwise(0))
    t = lambda c: F.col(c).cast("string")
    summary = F.concat(F.lit("Processing chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit(" of "), t("n"), F.lit(" from "), "source_file", F.lit(" (lines "), t("start_line"), F.lit("-"), t("end_line"), F.lit("). Contains "), F.size("units").cast("string"), F.lit(" semantic units."))
    tokens = F.floor(F.length(summary) / 4) + F.col("sig_tokens") + MAPPING_TOKENS * F.col("mappings") + F.floor(F.col("history") / 4) + REFERENCE_TOKENS * F.col("open_refs")
    return both.select(*keys, "signatures", "mappings", "open_refs", tokens.alias("tokens"))


def assembled(units: DataFrame, links: DataFrame) -> DataFrame:
    """(file, chunk, start_line, end_line, units, outbound, inbound): chunks of packed units with what crosses their borders.

    ``units`` are (file, chunk, pos, name, start_line, end_line), each in one chunk;
    ``links`` (file, source, target) say that a unit depends on a target. outbound
    holds the targets of a chunk's units that are no unit of the chunk, inbound the
    units elsewhere that depend on one of its units. Names compare whatever their
    case. The lists are sorted and distinct; a chunk's size bounds its units.
    """
    u = units.withColumn("key", F.upper("name"))
    own = u.select("file", "chunk", "key").distinct()
    both = links.select("file", "source", "target").distinct()

    def crossing(here: str, there: str, name: str) -> DataFrame:
        met = own.join(both.withColumn("key", F.upper(here)), ["file", "key"]).select("file", "chunk", F.col(there).alias("other"), F.upper(there).alias("key"))
        return met.join(own, ["file", "chunk", "key"], "left_anti").groupBy("file", "chunk").agg(F.array_sort(F.collect_set("other")).alias(name))

    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    chunks = u.groupBy("file", "chunk").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), names.alias("units"))
    none = F.array().cast("array<string>")
    out = chunks.join(crossing("source", "target", "outbound"), ["file", "chunk"], "left").join(crossing("target", "source", "inbound"), ["file", "chunk"], "left")
    return out.withColumn("outbound", F.coalesce("outbound", none)).withColumn("inbound", F.coalesce("inbound", none))


def _bucketed(ranges: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """``ranges`` with a row for each bucket of ``width`` lines from ``first`` to ``last``."""
    return ranges.where(F.col(first) <= F.col(last)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))


def gathered(lines: DataFrame, ranges: DataFrame, width: int = 1000) -> DataFrame:
    """(file, chunk, text): the lines (file, line, text) of ranges (file, chunk, first, last), joined; they meet in buckets by file and lines."""
    placed = lines.withColumn("bucket", F.floor(F.col("line") / width)).withColumnRenamed("text", "said")
    met = _bucketed(ranges, "first", "last", width).join(placed, ["file", "bucket"]).where("line between first and last")
    return met.groupBy("file", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("text"))


#: The order in which units are packed.
_PACKED = ("division", "data section", "section", "paragraph")


def plan(sources: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, max_tokens: int = MAX_TOKENS, enabled: bool = True) -> DataFrame:
    """(file, chunk, total_chunks, way, start_line, end_line, units): the chunks of each of ``sources`` (file, content), as ``policy`` says.

    ``single`` files are one chunk, ``windows`` share ``overlap`` lines, ``semantic``
    chunks hold units as ``packed`` gives them: divisions first, then data sections,
    sections and paragraphs, each in order, with a quarter of their characters as tokens.
    A chunk goes from its first unit's line to its last one's, and ``units`` are the ids
    it holds (for windows, those that it overlaps); so semantic chunks may overlap too.
    """
    from pyspark.sql import Window

    from codequarry.operators.extract import units as found_units

    sized = sources.select(F.col("file").alias("id"), (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    units = stored(found_units(sources).withColumn("lines", F.col("end_line") - F.col("start_line") + 1))
    ways = stored(policy(sized, units.select(F.col("file").alias("id"), "lines"), max_lines, enabled).join(sized, "id"))
    of = lambda way: ways.where(F.col("way") == way).select("id", "lines")
    one = of("single").select(F.col("id").alias("file"), F.lit(0).alias("chunk"), F.lit("single").alias("way"), F.lit(1).alias("start_line"), F.col("lines").cast("int").alias("end_line"))
    by_line = windows(of("windows"), max_lines, overlap).select(F.col("id").alias("file"), "chunk", F.lit("windows").alias("way"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))
    rank = F.array_position(F.array(*[F.lit(k) for k in _PACKED]), F.col("kind"))
    of_files = units.join(of("semantic").select(F.col("id").alias("file")), "file", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy(rank, "start_line", "unit")))
    of_files = stored(of_files)
    kind = F.when(F.col("kind") == "data section", "section").otherwise(F.col("kind"))
    placed = packed(of_files.select("file", "pos", kind.alias("kind"), "lines", F.floor(F.col("chars") / 4).alias("tokens")), max_lines, max_tokens).select("file", "pos", "chunk").join(of_files, ["file", "pos"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "unit"))), lambda x: x["unit"])
    semantic = placed.groupBy("file", "chunk").agg(F.lit("semantic").alias("way"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), ordered.alias("units"))
    cut = stored(one.union(by_line))
    held = _bucketed(cut, "start_line", "end_line", 1000).join(_bucketed(units.select("file", "unit", F.col("start_line").alias("x"), F.col("end_line").alias("y"), rank.alias("rank")), "x", "y", 1000), ["file", "bucket"])
    held = held.where("x <= end_line and y >= start_line").groupBy("file", "chunk").agg(F.transform(F.array_sort(F.collect_set(F.struct("rank", "x", "unit"))), lambda u: u["unit"]).alias("units"))
    cut = cut.join(held, ["file", "chunk"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<string>")))
    every = stored(semantic.unionByName(cut))
    total = every.groupBy("file").agg(F.count("*").cast("int").alias("total_chunks"))
    return every.join(total, "file").select("file", "chunk", "total_chunks", "way", "start_line", "end_line", "units")


def with_texts(chunks: DataFrame, sources: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``plan``'s chunks with ``content`` and, from the second of a file on, ``before``: the ``overlap`` lines above it.

    Lines go to their chunks by file and range, so that only a chunk's own lines meet in a task.
    """
    from codequarry.operators.extract import lines as source_lines

    lines = source_lines(sources)
    content = gathered(lines, chunks.select("file", "chunk", F.col("start_line").alias("first"), F.col("end_line").alias("last"))).withColumnRenamed("text", "content")
    above = chunks.where("chunk > 0").select("file", "chunk", F.greatest(F.col("start_line") - overlap, F.lit(1)).alias("first"), (F.col("start_line") - 1).alias("last"))
    before = gathered(lines, above).withColumnRenamed("text", "before")
    return chunks.join(content, ["file", "chunk"], "left").join(before, ["file", "chunk"], "left")
