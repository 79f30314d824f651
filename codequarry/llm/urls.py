"""URL filter: host rules first, then the ratio of two character language models.

Built-in functions only. URLs that a rule allows or blocks train two smoothed
variable-order Markov models over characters, one for each verdict:
p_m(c | context) = (count(context c) + mu * p_{m-1}(c | shorter context)) / (count(context) + mu)
for contexts of 0 to ``order`` characters. A URL's score is the mean over its
characters of log p_allow - log p_block, each from the longest context in which
either model has seen the character. The cut is calibrated on ruled URLs that
the models have not seen.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import stored

#: verdict, host and path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of the models; digits count as 0 and all others as ~. ^ and $ mark the ends.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./:?=&_%#+-~^$"
#: Most rows of a model that is broadcast, some tens of MB.
SMALL_GRAMS = 200_000
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a URL without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOW), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def _marked(url: Column, order: int) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOW), "[1-9]", "0")
    return F.concat(F.lit("^" * order), F.regexp_replace(plain, r"[^a-z0./:?=&_%#+-]", "~"), F.lit("$"))


def _grams(text: Column, order: int) -> Column:
    """Each character with its ``order`` characters of context."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - order), lambda i: F.substring(text, i, order + 1))


def model(labelled: DataFrame, order: int = 3, mu: float = 4.0) -> DataFrame:
    """(url, verdict) -> (gram, llr): log ratio of each seen character after each seen context, 0 to ``order`` long.

    The table has at most len(ALPHABET) ** (order + 1) rows, whatever the input.
    """
    full = labelled.select("verdict", F.explode(_grams(_marked(F.col("url"), order), order)).alias("g")).groupBy("g").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    full = stored(full)
    tables = []
    for m in range(order + 1):
        gram = F.substring(F.col("g"), order + 1 - m, m + 1)
        seen = full.groupBy(gram.alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = seen.groupBy(F.substring("gram", 1, m).alias("c")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
        seen = seen.withColumn("c", F.substring("gram", 1, m)).join(context, "c")
        if m:
            below = tables[-1].select(F.col("gram").alias("s"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            seen = seen.withColumn("s", F.substring("gram", 2, m)).join(below, "s")
        else:
            seen = seen.withColumns({"qa": F.lit(1 / len(ALPHABET)), "qb": F.lit(1 / len(ALPHABET))})
        tables.append(seen.select("gram", ((F.col("a") + mu * F.col("qa")) / (F.col("ca") + mu)).alias("pa"), ((F.col("b") + mu * F.col("qb")) / (F.col("cb") + mu)).alias("pb")))
    every = reduce(DataFrame.union, tables)
    return stored(every.select("gram", F.log(F.col("pa") / F.col("pb")).alias("llr")))


def scored(urls: DataFrame, grams: DataFrame, order: int = 3) -> DataFrame:
    """(url) -> (url, score): mean log ratio by character. Equal URLs have one row.

    The model is broadcast while it has at most SMALL_GRAMS rows, and each URL is
    scored where it stands; a larger one is joined to the distinct contexts first.
    """
    text = urls.select("url", F.explode(_grams(_marked(F.col("url"), order), order)).alias("g"))
    small = grams.count() <= SMALL_GRAMS

    def known(rows: DataFrame) -> DataFrame:
        for m in range(order, -1, -1):
            part = grams.where(F.length("gram") == m + 1).select(F.col("gram").alias(f"g{m}"), F.col("llr").alias(f"l{m}"))
            rows = rows.withColumn(f"g{m}", F.substring("g", order + 1 - m, m + 1)).join(F.broadcast(part) if small else part, f"g{m}", "left")
        return rows.withColumn("llr", F.coalesce(*[F.col(f"l{m}") for m in range(order, -1, -1)], F.lit(0.0)))

    if small:
        return known(text).groupBy("url").agg(F.avg("llr").alias("score"))
    text = stored(text.groupBy("url", "g").agg(F.count("*").alias("n")))
    best = stored(known(text.select("g").distinct()).select("g", "llr"))  # stored, so that the join may split a frequent context
    return text.join(best, "g").groupBy("url").agg((F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("score"))


def cut(scores: DataFrame) -> float:
    """The calibrated threshold of (score, verdict): between the low end of allowed and the high end of blocked URLs; 0 without examples."""
    ends = scores.agg(F.percentile_approx(F.when(F.col("verdict") == "allow", F.col("score")), 0.05, 10000), F.percentile_approx(F.when(F.col("verdict") == "block", F.col("score")), 0.95, 10000)).first()
    known = [x for x in ends if x is not None and math.isfinite(x)]
    return sum(known) / 2 if len(known) == 2 else 0.0


def judged(pages: DataFrame, rules=RULES, order: int = 3) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and score (null where a rule decides).

    A null URL is treated as an empty one, which the models judge by its end mark.
    Repeated rows get equal results; an empty table gives an empty one.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", verdict).withColumn("fold", F.when(F.col("by_rule").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(5))))
    grams = model(rows.where("fold > 0").select("url", F.col("by_rule").alias("verdict")), order)
    scores = stored(scored(rows.where("by_rule is null or fold = 0"), grams, order))
    ruled = rows.where("fold = 0").select("url", F.col("by_rule").alias("verdict")).distinct()
    at = cut(scores.join(ruled, "url"))
    out = rows.where("by_rule is null").join(scores, "url", "left")
    out = out.withColumn("verdict", F.when(F.col("score") >= at, "allow").otherwise("block"))
    return rows.where("by_rule is not null").select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("score")).union(out.select("page_id", "host", "path", "rule", "verdict", "score"))
