"""Personal data by patterns, and terms that disclose it by their co-occurrence in the corpus.

Built-in functions only. Patterns give the base spans. For every protected
entity (a value found by a pattern, and each kind as a whole) the information
content is IC(e) = log2(N / df(e)) over all N documents. A term discloses
PMI(t; e) / IC(e) of the entity, with PMI(t; e) = log2(N * df(t, e) / (df(t) * df(e))):
1 if the term never occurs without the entity. df(t) and df(t, e) count whole
documents, in which the term may stand anywhere outside the base spans. Terms whose
disclosure reaches ``generalise`` are replaced by a placeholder, those that reach
``remove`` are taken out, at every place in every document that holds the entity.

A pair needs ``support`` documents, as the ratio of smaller counts says nothing.
So entities and terms of fewer such documents go before they are paired, and so
does a pair with df(t) > N**(1-g) * df(e)**g at g = ``generalise``: even with
df(t, e) = df(e) its share would be less than g. Neither loses a risky pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import keyed, stored

#: Kinds in the order that breaks ties of a start.
KINDS = ("email", "ip", "card", "phone", "term")
#: The patterns in Java's dialect. Possessive loops and the look-behind (with \G, the end of the match before)
#: give the same leftmost matches as the plain patterns without trying each start inside a long run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}{3,}"
#: Most terms that are broadcast, some tens of MB.
SMALL_TERMS = 500_000
_SPAN = "array<struct<start:int,kind:int,end:int,found:string>>"
#: Stands for a letter of a base span in ``_masked``: no letter itself, and a code point that texts don't hold.
_HIDDEN = "\ufdd0"
#: Whole words of a masked text.
_CLEAR = rf"(?<![\p{{L}}{_HIDDEN}])\p{{L}}{{3,}}+(?!{_HIDDEN})"


#: Steps of a fold that are appended to one array, and characters of a text that are cut together.
_CHUNK, _BLOCK = 256, 1024


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, step, kind: str) -> Column:
    """The elements that ``step`` makes of (place so far, item) one after the other: it gives (at, out).

    Elements are gathered in chunks, so that a long array isn't copied for each of its elements.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(a: Column, x: Column) -> Column:
        at, out = step(a["at"], x)
        return F.struct(at.cast("int").alias("at"), F.array_append(a["out"], out).cast(f"array<{kind}>").alias("out"))

    def chunks(all_: Column) -> Column:
        def add(a: Column, c: Column) -> Column:
            part = F.aggregate(F.slice(all_, c * _CHUNK + 1, F.lit(_CHUNK)), F.struct(a["at"].alias("at"), none.alias("out")), within)
            return _let(part, lambda r: F.struct(r["at"].alias("at"), F.array_append(a["out"], r["out"]).cast(f"array<array<{kind}>>").alias("out")))

        last = F.greatest((F.size(all_) - 1) / _CHUNK, F.lit(0)).cast("int")
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), last), start, add, lambda a: a["out"]))

    return _let(items, chunks)


def _steps(text: Column, pattern: str) -> Column:
    """Each match with the gap before it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(matches, lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("gap"), m.alias("found")))


def _places(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as (start, kind, end, found), in code points."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        here = at + F.length(x["gap"])
        end = here + F.length(x["found"])
        return end, F.struct(here.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found"))

    return _fold(_steps(text, pattern), step, "struct<start:int,kind:int,end:int,found:string>")


def _replaced(text: Column, spans: Column, put) -> Column:
    """``text`` with ``put`` of (span, its characters, whether an earlier span reaches into it) for each of ``spans`` (start, kind, end, out), sorted by start.

    Characters under several spans belong to the first. The text is cut in blocks,
    as finding a place in a string takes time in proportion to the place.
    """
    kind = "struct<at:int,start:int,end:int,kind:int,out:int,apart:boolean>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start, end = F.greatest(at, s["start"]), F.greatest(at, s["end"])
        return end, F.struct(at.alias("at"), start.alias("start"), end.alias("end"), s["kind"].alias("kind"), s["out"].alias("out"), (s["start"] >= at).alias("apart"))

    def join(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = (start / _BLOCK).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, (end / _BLOCK).cast("int") - first + 1), "")
            return F.substring(some, start % _BLOCK + 1, end - start)

        parts = F.transform(_fold(spans, step, kind), lambda m: F.concat(cut(m["at"], m["start"]), put(m, cut(m["start"], m["end"]))))
        last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), cut(last, F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)), join)


def _luhn(digits: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(s: Column, kind: str) -> Column:
    found = s["found"]
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = F.translate(found, " -", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(found, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _only_valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(s, kind))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """The valid matches of every pattern, by start, then kind."""
    kinds = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        all_ = F.when(text.rlike(_HINT[kind]), _places(text, pattern, i)).otherwise(F.array().cast(_SPAN))
        kinds.append(_only_valid(all_, kind))
    return F.sort_array(F.concat(*kinds))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(text: Column, spans: Column) -> Column:
    """The text with as many code points, in which base spans hold no letter."""
    hidden = lambda m, x: F.regexp_replace(F.regexp_replace(x, r"(?s)\P{L}", "\x01"), r"\p{L}", _HIDDEN)
    return _replaced(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).alias("out"))), hidden)


def _terms(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower))


def _marked(masked: Column, risky: Column) -> Column:
    """Every place of the risky terms (term, out) in a masked text, as (start, kind, end, out)."""
    kind = "struct<start:int,kind:int,end:int,out:int>"

    def every(outs: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            here = at + F.length(x["gap"])
            end = here + F.length(x["found"])
            return end, F.struct(here.alias("start"), F.lit(4).alias("kind"), end.alias("end"), F.try_element_at(outs, F.lower(x["found"])).alias("out"))

        return F.filter(_fold(_steps(masked, _CLEAR), step, kind), lambda s: s["out"].isNotNull())

    return _let(F.map_from_entries(risky), every)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the base spans and, where there are any, their entities, the masked text and the words it has no more; one row per document, stored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("fp")).withColumn("base", base_spans(F.col("text")))
    entity = lambda s, value: F.struct(s["kind"].alias("kind"), value.alias("value"))
    each = F.transform("base", lambda s: entity(s, F.xxhash64(s["found"])))
    kinds = F.transform("base", lambda s: entity(s, F.lit(0).cast("bigint")))
    masked = F.when(F.size("base") > 0, _masked(F.col("text"), F.col("base")))
    df = df.select("doc_id", "fp", "text", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"), F.array_distinct(F.concat(kinds, each)).alias("entities"), masked.alias("masked"))
    hidden = F.when(F.col("masked").isNotNull(), F.array_except(_terms(F.col("text"), _WORD), _terms(F.col("masked"), _CLEAR)))
    return stored(df.select("doc_id", "fp", "base", "entities", "masked", hidden.alias("hidden")))


def disclosing(docs: DataFrame, base: DataFrame, generalise: float = 0.75, remove: float = 0.95, support: int = 3) -> DataFrame:
    """(doc_id, fp, risky): the disclosing terms (term, out) of the documents that have any."""
    n = base.count()
    sides = base.where(F.size("entities") > 0).dropDuplicates(["doc_id", "fp"])
    entities = sides.select("doc_id", "fp", F.explode("entities").alias("entity"))
    df_e = entities.groupBy("entity").agg(F.count("*").alias("df_e")).where((F.col("df_e") >= support) & (F.col("df_e") < n))
    held = entities.join(df_e, "entity").groupBy("doc_id", "fp").agg(F.collect_list(F.struct("entity", "df_e")).alias("held")).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "held")
    terms = stored(sides.join(held, sides.doc_id.eqNullSafe(held.d) & (sides.fp == held.f)).select("doc_id", "fp", "held", F.explode(_terms(F.col("masked"), _CLEAR)).alias("term")))
    wanted = stored(terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= support).select("term"))
    # in how many documents a term stands outside base spans: all that hold it less those where it stands in spans only
    words = docs.select(F.explode(_terms(F.col("text"), _WORD)).alias("term"), F.lit(1).alias("n")).union(base.where(F.size("hidden") > 0).select(F.explode("hidden").alias("term"), F.lit(-1).alias("n")))
    if wanted.count() <= SMALL_TERMS:  # few enough to drop other words before they are dealt
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    can = lambda of: F.log2("df_t") <= (1 - generalise) * F.log2(F.lit(float(n))) + generalise * F.log2(of) + 1e-6
    most = df_e.agg(F.max("df_e")).first()[0] or 1
    # without the terms that no entity can pass; stored, so that the join may split a frequent term
    df_t = stored(words.groupBy("term").agg(F.sum("n").alias("df_t")).where(can(F.lit(float(most)))).join(wanted, "term", "left_semi"))
    pairs = terms.join(df_t, "term").select("doc_id", "fp", "term", "df_t", F.explode(F.filter("held", lambda x: can(x["df_e"]))).alias("x")).select("doc_id", "fp", "term", "df_t", "x.entity", "x.df_e")
    pairs = stored(pairs)
    df_te = pairs.groupBy("term", "entity").agg(F.count("*").alias("df_te"), F.first("df_t").alias("df_t"), F.first("df_e").alias("df_e")).where(F.col("df_te") >= support)
    bits = F.log2(F.lit(float(n)) * F.col("df_te") / (F.col("df_t") * F.col("df_e"))) / F.log2(F.lit(float(n)) / F.col("df_e"))
    risky = df_te.withColumn("share", bits).where(F.col("share") >= generalise).select("term", "entity", F.when(F.col("share") >= remove, 1).otherwise(0).alias("out"))
    found_ = pairs.join(risky, ["term", "entity"]).groupBy("doc_id", "fp", "term").agg(F.min("out").alias("out"))
    return found_.groupBy("doc_id", "fp").agg(F.collect_list(F.struct("term", "out")).alias("risky"))


def annotated(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, fp, base, terms for each row of ``docs`` (doc_id, text); see ``spans_of`` and ``sanitised``.

    A null text counts as empty and has no span. Rows are told apart by doc_id and
    text, so a doc_id (null too) may repeat; equal rows get equal results. An empty
    table gives an empty one.
    """
    base = found(docs)
    terms = disclosing(docs, base, **thresholds).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "risky")
    base = base.select("doc_id", "fp", "base", "masked")
    both = base.join(terms, base.doc_id.eqNullSafe(terms.d) & (base.fp == terms.f), "left")
    return both.select("doc_id", "fp", "base", F.when(F.col("risky").isNotNull(), _marked(F.col("masked"), F.col("risky"))).alias("terms"))


def spans_of(marked: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans as text."""
    counts = [_count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    terms = F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,kind:int,end:int,out:int>>"))
    every = F.sort_array(F.concat(plain(F.col("base")), F.array_distinct(plain(terms))))
    return marked.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with personal data replaced by ``[KIND]``, risky terms by ``[TERM]`` or nothing; other columns stay.

    Overlapping spans are taken out once, with the name of the one that starts first.
    """
    marked = annotated(docs, **thresholds).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "base", "terms").dropDuplicates(["d", "f"])
    marked = marked.where((F.size("base") > 0) | F.col("terms").isNotNull()).select("d", "f", F.struct("base", "terms").alias("found"))
    both = keyed(docs).join(marked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fp") == F.col("f")), "left")
    cast = "array<struct<start:int,kind:int,end:int,out:int>>"
    base = F.transform(F.col("found.base"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0).alias("out"))).cast(cast)
    spans = F.sort_array(F.concat(base, F.coalesce(F.col("found.terms").cast(cast), F.array().cast(cast))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    put = lambda m, x: F.when(m["apart"] & (m["out"] == 0), F.get(names, m["kind"])).otherwise("")
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(_let(spans, lambda s: _replaced(F.col("row.text"), s, put)))
    return both.select(F.col("row").withField("text", text).alias("row")).select("row.*")
