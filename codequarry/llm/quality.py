"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with this from for was are not is in it as on at by an or "
    "le la les de des du et en un une que qui dans pour est pas sur avec au "
    "der die das und ist von den mit sich des dem ein eine nicht auf zu für im "
    "el los las del que y en un una por con para es se no su como lo"
).split()

#: Letters of those languages.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\u00e0\u00e2\u00e4\u00e1\u00e7\u00e9\u00e8\u00ea\u00eb\u00ed\u00ee\u00ef\u00f1\u00f3\u00f4\u00f6\u0153\u00f9\u00fa\u00fb\u00fc\u00df\u00c0\u00c2\u00c4\u00c1\u00c7\u00c9\u00c8\u00ca\u00cb\u00cd\u00ce\u00cf\u00d1\u00d3\u00d4\u00d6\u0152\u00d9\u00da\u00db\u00dc"
#: metric, comparison that a kept text satisfies, threshold; with a fourth entry, for texts only in which that measure holds.
#: Running text of the listed languages has at least 10 stop words in 100 here, so one with fewer than 2 is a list or a
#: heap of words. A text of another language has none either, so the rule asks first whether the letters are theirs.
RULES = (
    ("n_words", ">=", 50),
    ("repeat_word_ratio", "<=", 0.5),
    ("mean_word_length", ">=", 2.0),
    ("mean_word_length", "<=", 16.0),
    ("symbol_ratio", "<=", 0.05),
    ("dup_line_ratio", "<=", 0.5),
    ("stop_word_ratio", "<=", 0.8),
    ("stop_word_ratio", ">=", 0.02, "listed_letters"),
)

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _less(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (text) with the measures of each whole text added; columns of these names, and _words, _lines, _h, _w and _twice, are replaced.

    Words are runs of characters other than 0x20 and 0x09-0x0D. n_repeat_words
    counts words inside a 3-word window that the text holds at least twice:
    windows are compared by 64-bit hashes, the places of the repeated ones are
    sorted, and the union of their words is counted. n_e are the letters e of any
    case and accent, n_other letters that the listed languages don't have. A null text
    counts as empty and has 0 in every measure; rows repeat as those of ``docs``; an
    empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(F.translate(text, _SPACE, " " * 6), " "), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", _less(text, _SPACE).cast("long")).withColumn("n_symbols", (F.length(text) - _less(text, _SYMBOLS)).cast("long"))
    df = df.withColumn("n_e", (F.length(text) - _less(text, "eE\u00e9\u00e8\u00ea\u00eb\u00c9\u00c8\u00ca\u00cb")).cast("long")).withColumn("n_other", F.length(F.regexp_replace(text, rf"[\P{{L}}{LETTERS}]+", "")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACE, "") != ""))
    df = df.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", F.size("_lines").cast("long") - F.size(F.array_distinct("_lines")))
    df = df.withColumn("n_stop_words", F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"))
    m = F.greatest(F.size("_words") - 2, F.lit(0))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_h", hashes)
    pair = F.zip_with(F.slice("_h", 1, m), F.slice("_h", 2, m), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_w", F.zip_with(pair, F.slice("_h", 3, m), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("_twice", F.when(F.size(F.array_distinct("_w")) == F.size("_w"), F.array().cast("array<struct<w:bigint,i:int>>")).otherwise(F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda s, j: F.coalesce(s["w"] == F.get(F.col("_twice"), j)["w"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_twice", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s["i"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("reach"))
    step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["reach"])).alias("n"), (p + 3).alias("reach"))
    return df.withColumn("n_repeat_words", F.aggregate(places, start, step, lambda a: a["n"])).drop("_words", "_lines", "_h", "_w", "_twice")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def compiled(rules=RULES) -> Column:
    """The table as one boolean expression over the columns of ``measured``."""
    metrics = {
        "n_words": F.col("n_words"),
        "stop_word_ratio": _ratio(F.col("n_stop_words"), F.col("n_words")),
        "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word_length": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": _ratio(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    }
    # nearly all letters are those of the listed languages, and as many of them e as in each of those (11 to 17 in 100)
    only_for = {"listed_letters": (50 * F.col("n_other") <= F.col("word_chars")) & (12 * F.col("n_e") >= F.col("word_chars"))}
    verdict = F.lit(True)
    for metric, sign, bound, *when in rules:
        holds = metrics[metric] >= bound if sign == ">=" else metrics[metric] <= bound
        verdict = verdict & (~only_for[when[0]] | holds if when else holds)
    return verdict


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """``measured`` with base_failed and kept added. Null and empty texts fail; every row comes back, repeats too."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def kept_documents(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; the measures live in a struct beside them."""
    inner = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text")), rules)
    # not a filter: the optimizer would copy the nested measures into its condition again and again
    return inner.select(F.inline(F.when(F.col("kept"), F.array("_row"))))


#: DuckDB SQL for op9_quality.
SQL = """
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
g as (select rid, unnest(generate_series(1, len(ws) - 2)) i, ws from w where len(ws) >= 3),
v as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] x from g),
r as (select rid, i, count(*) over (partition by rid, x) c from v),
c as (select rid, count(distinct p) n from (select rid, i + unnest([0, 1, 2]) p from r where c > 1) group by rid),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) in (STOP)))::bigint n_stop_words,
  (length(t) - length(regexp_replace(t, '[eE\u00e9\u00e8\u00ea\u00eb\u00c9\u00c8\u00ca\u00cb]', '', 'g')))::bigint n_e, length(regexp_replace(t, '[\\P{L}LETTERS]+', '', 'g'))::bigint n_other
  from w left join c using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_e, n_other, base_failed,
  not base_failed and word_chars / n_words between 2.0 and 16.0 and n_symbols / word_chars <= 0.05 and n_dup_lines / n_lines <= 0.5 and n_stop_words / n_words <= 0.8
    and (n_stop_words / n_words >= 0.02 or 50 * n_other > word_chars or 12 * n_e < word_chars) as kept
from b
""".replace("LETTERS", LETTERS).replace("STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
