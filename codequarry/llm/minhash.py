"""Near-duplicate documents by bottom-k sketches from one hash function.

Steps, each a Spark job over all rows:

1. Every text becomes the sorted set of 64-bit hashes of its word shingles.
   Texts with equal sets are one class; the rest works on one text of a class.
2. A class keeps its k least hashes. Inverted lists of these values give the
   pairs of classes that share one. Lists of at most ``short`` classes give all
   their pairs. Longer lists are treated below.
3. The sketch of the union of two sketches estimates their Jaccard similarity;
   pairs that share fewer of its values than ``least_shared`` go.
4. The exact Jaccard similarity of the full sets confirms each link.

Long lists (a boilerplate line, thousands of near copies) never give all their
pairs. A pair that shares no value of a short list has all its shared values in
long lists, so a class with fewer values there than the estimate asks for can't be
in a pair that passes it; how many of its own values the other class shares does
not matter. The remaining ("dense") classes are first linked to the densest class of
each long list. Where a list then still spans several components, its classes are
compared block by block, all pairs of two blocks by one matrix product. The blocks
are sketches first; only classes that pass the estimate with another come again
with their full sets, and only links come out. Pairs of one component
are left out, and so are pairs whose two classes have the same first long list, as
they meet there; the largest such group of a list is not compared with itself.
Blocks are bounded in classes and in shingles. Nothing is capped.

A link is lost if its estimate is too low: for a link right at the threshold with
a probability of at most P(Binomial(k, t) < c), 3.5e-10 at k = 32 and t = 0.80
(c = 10), 1.2e-10 at t = 0.85 (c = 12). The cut for dense classes follows from the
estimate and loses nothing more. A class stands in the lists of its first ``m``
hot values; a link is missed there if none of them is shared, at most (1-t)**m:
8.2e-10 at t = 0.80 (m = 13), 8.6e-10 at t = 0.85 (m = 11). Above the threshold
all of these are far smaller. Classes are known by 64 bits of a digest of their set.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.graph import components
from codequarry.llm.shared import stored
from codequarry.llm.textscan import mix64, slices

_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], dtype=np.uint64)

#: The estimate, and the choice of long lists, each lose a link right at the threshold with at most this probability.
LOSS = 1e-9


def least_shared(k: int, t: float) -> int:
    """The largest c with P(Binomial(k, t) < c) <= LOSS: a link of similarity t shares c of the union's k least values."""
    below = 0.0
    for c in range(k + 1):
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > LOSS:
            return c
    return k


def shingle_sets(texts: pa.Array, width: int):
    """The sorted distinct shingle hashes (int64) of each text; empty where there is no word."""
    for _, _, scan in slices(texts):
        scan.words()
        sums = scan.sums()
        words = scan.hashes(sums, scan.start, scan.end)
        n = len(words)
        many = np.zeros(max(0, n - width + 1), dtype=np.uint64)
        for j in range(width):
            many += words[j : j + len(many)] * _ODD[j]
        many = mix64(many).view(np.int64)
        bounds = scan.word_off.tolist()
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= width:
                yield np.unique(many[a : b - width + 1])
            elif b > a:
                whole = mix64((words[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
                yield whole.view(np.int64)
            else:
                yield many[:0]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def sketched(docs: DataFrame, k: int, width: int) -> DataFrame:
    """(doc_id, fp) -> (doc_id, fp, vid, n, sketch); vid is null where a text has no word."""

    def run(batches):
        for batch in batches:
            vid, n, sketch = [], [], []
            for s in shingle_sets(batch.column(2), width):
                vid.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                n.append(len(s))
                sketch.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vid, pa.int64()), pa.array(n, pa.int64()), _lists(sketch)], names=["doc_id", "fp", "vid", "n", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(run, f"doc_id {kind}, fp bigint, vid bigint, n bigint, sketch array<bigint>")


def full_sets(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(vid, doc_id, fp) and the documents -> (vid, items): the full sets of the wanted classes only."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(shingle_sets(batch.column(1), width)))], names=["vid", "items"])

    rows = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("f"), "text")
    found = wanted.join(rows, wanted.doc_id.eqNullSafe(rows.d) & (wanted.fp == rows.f)).select("vid", "text")
    return found.mapInArrow(run, "vid bigint, items array<bigint>").dropDuplicates(["vid"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have a Jaccard similarity of at least percent / 100."""
    both = pairs.join(sets.select(F.col("vid").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("vid").alias("b"), F.col("items").alias("y")), "b")
    return both.withColumn("i", F.size(F.array_intersect("x", "y"))).where(100 * F.col("i") >= percent * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets, each of ``left`` with each of ``right``."""
    every = np.concatenate([*left, *right])
    values, where, count = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # only values of several sets matter
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    kept = count[where] > 1
    row, col = row[kept], rank[where[kept]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    last = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, last, columns):
        a, b = np.searchsorted(col, (at, at + columns))
        grid = np.zeros((len(left) + len(right), min(columns, last - at)), dtype=np.float32)
        grid[row[a:b], col[a:b] - at] = 1
        total += grid[: len(left)] @ grid[len(left) :].T
    return total


def _maybe(sketches: list[np.ndarray], size: np.ndarray, comp: np.ndarray, block: np.ndarray, key: tuple, percent: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two blocks, and which pairs of them fit in size, lie in two components and pass the estimate."""
    _, bi, bj = key
    left = np.flatnonzero(block == bi)
    right = left if bi == bj else np.flatnonzero(block == bj)
    low, high = np.minimum.outer(size[left], size[right]), np.maximum.outer(size[left], size[right])
    maybe = (100 * low >= percent * high) & (comp[left][:, None] != comp[right][None, :])
    if maybe.any():
        maybe &= _shared_counts([sketches[r] for r in left], [sketches[r] for r in right]) >= least * np.minimum(low, k)
    return left, right, maybe


def _hopeful(percent: int, k: int, least: float):
    """The rows of one pair of blocks that pass the estimate with any other; sketches alone are looked at."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, maybe = _maybe([np.asarray(x) for x in pdf["sketch"]], pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["block"].to_numpy(), key, percent, k, least)
        rows = np.union1d(left[maybe.any(axis=1)], right[maybe.any(axis=0)])
        return pdf.iloc[rows][["v", "vid", "comp", "block", "bi", "bj"]]

    return run


def _across(percent: int, k: int, least: float):
    """Links between components inside one pair of blocks of a long list: estimate, then exact test, all pairs at once."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        items, comp, vid = [np.asarray(x) for x in pdf["items"]], pdf["comp"].to_numpy().copy(), pdf["vid"].to_numpy()
        size = np.array([len(x) for x in items])
        left, right, maybe = _maybe([x[:k] for x in items], size, comp, pdf["block"].to_numpy(), key, percent, k, least)
        out = []
        if maybe.any():
            rows, cols = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
            shared = _shared_counts([items[r] for r in left[rows]], [items[r] for r in right[cols]])
            sizes = size[left[rows]][:, None] + size[right[cols]][None, :]
            sure = maybe[np.ix_(rows, cols)] & (100 * shared >= percent * (sizes - shared))
            for p, q in zip(*np.nonzero(sure)):
                a, b = left[rows[p]], right[cols[q]]
                if comp[a] != comp[b]:
                    out.append((vid[a], vid[b]))
                    comp[comp == comp[b]] = comp[a]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 32, short: int = 32, block: int = 512, block_items: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the text's ``fp``.

    ``docs`` needs doc_id and text; other columns are not read. Documents whose
    sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 are linked; component_id is the least doc_id reachable over
    links, itself included. A text of fewer words than ``width`` has its whole
    word sequence as the one shingle.

    Null and blank texts have no shingle and are linked with nothing: their
    component_id is their doc_id. A null doc_id takes part as a text but is never
    the least of a component unless all its ids are null; such a row is kept only
    then. Repeated rows give repeated results. An empty table gives an empty one.
    """
    t = percent / 100
    least = least_shared(k, t) / k
    lists_each = k if t <= 0 else 1 if t >= 1 else min(k, math.ceil(math.log(LOSS) / math.log(1 - t)))
    rows = stored(sketched(docs, k, width))
    classes = stored(
        rows.where("vid is not null").groupBy("vid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    posts = classes.select("vid", "n", F.explode("sketch").alias("v"))
    lists = posts.groupBy("v").count().where("count > 1")
    posts = stored(posts.join(lists, "v"))
    # short lists: all their pairs of fitting sizes
    member = F.collect_list(F.struct("vid", "n")).alias("l")
    fits = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = posts.where(F.col("count") <= short).groupBy("v").agg(member).select(F.explode(F.expr(f"flatten(transform(l, x -> transform(filter(l, y -> y.vid > x.vid and {fits}), y -> struct(x.vid as a, y.vid as b))))")).alias("p")).select("p.*")
    # long lists: links to the densest class of each
    hot = posts.where(F.col("count") > short)
    own = classes.join(hot.groupBy("vid").agg(F.sort_array(F.collect_list("v")).alias("hot")), "vid").withColumn("own", F.size("sketch") - F.size("hot"))
    small = math.floor(k * t)
    dense = own.where((F.size("hot") >= least * F.size("sketch")) & ((F.col("n") > small) | (100 * F.col("own") <= (100 - percent) * F.col("n"))))
    dense = stored(dense.select("vid", "n", "own", "hot"))
    inside = dense.select("vid", "n", "own", F.col("hot")[0].alias("first"), F.explode(F.slice("hot", 1, lists_each)).alias("v"))
    chief = stored(inside.groupBy("v").agg(F.max_by(F.struct("vid", "n"), F.struct(-F.col("own"), "vid")).alias("c")))  # stored, so that the join may split a long list
    stars = inside.alias("x").join(chief, "v").select(F.col("x.vid").alias("p"), F.col("x.n").alias("np"), F.col("c.vid").alias("q"), F.col("c.n").alias("nq")).where(f"p <> q and 100 * least(np, nq) >= {percent} * greatest(np, nq)").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    pairs = pairs.union(stars).distinct()
    # estimate on the sketch of the union
    sk = classes.select("vid", "n", "sketch")
    pairs = pairs.join(sk.select(F.col("vid").alias("a"), F.col("sketch").alias("x")), "a").join(sk.select(F.col("vid").alias("b"), F.col("sketch").alias("y")), "b")
    union = F.slice(F.sort_array(F.array_union("x", "y")), 1, k)
    pairs = pairs.withColumn("u", union).where(F.size(F.array_intersect(F.array_intersect("x", "y"), "u")) >= least * F.size("u"))
    pairs = stored(pairs.select("a", "b"))
    # exact test on full sets
    wanted = pairs.select(F.col("a").alias("vid")).union(pairs.select("b")).union(dense.select("vid")).distinct().join(classes.select("vid", "rep.doc_id", "rep.fp"), "vid")
    sets = stored(full_sets(wanted, docs, width))
    links = stored(_linked(pairs, sets, percent))
    roots = components(links)
    # long lists that still span several components: all but the largest group of a list against the whole list
    placed = inside.join(roots, inside.vid == roots.v, "left").select(inside.vid, inside.n, inside.v, "first", F.coalesce("root", "vid").alias("comp"))
    size = (F.count("*").alias("c"), F.sum("n").alias("w"))
    by_comp = placed.groupBy("v", "comp").agg(*size).select("v", F.lit(True).alias("comps"), F.col("comp").alias("key"), "c", "w")
    by_first = placed.where("first <> v").groupBy("v", "first").agg(*size).select("v", F.lit(False).alias("comps"), F.col("first").alias("key"), "c", "w")
    all_ = [F.sum(F.when(F.col("comps"), F.col(x)).otherwise(0)).alias(x) for x in ("c", "w")]
    spread = by_comp.union(by_first).groupBy("v").agg(F.count_if("comps").alias("n_comps"), F.max(F.struct("c", "comps", "key", "w")).alias("m"), *all_).where("n_comps > 1")
    parts = lambda c, w: F.ceil(F.greatest(c / block, w / block_items)).cast("int")
    spread = stored(spread.select("v", F.col("m.comps").alias("comps"), F.col("m.key").alias("key"), parts(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("others"), parts(F.col("m.c"), F.col("m.w")).alias("mains")).where("others > 0"))
    placed = placed.join(spread, "v").withColumn("out", F.when(F.col("comps"), F.col("comp")).otherwise(F.col("first")) != F.col("key"))
    place = F.pmod(F.xxhash64("vid"), F.when(F.col("out"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    placed = placed.withColumn("block", F.when(F.col("out"), place).otherwise(F.col("others") + place))
    last = F.col("others") + F.when(F.col("out"), F.col("mains")).otherwise(0) - 1
    placed = placed.join(classes.select("vid", "sketch"), "vid").withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    placed = placed.select("v", "vid", "n", "comp", "block", "sketch", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    hopeful = stored(placed.groupBy("v", "bi", "bj").applyInPandas(_hopeful(percent, k, least), "v bigint, vid bigint, comp bigint, block int, bi int, bj int"))
    more = hopeful.join(sets, "vid").groupBy("v", "bi", "bj").applyInPandas(_across(percent, k, least), "a bigint, b bigint")
    more = stored(more)
    if not more.isEmpty():  # links between components join their roots
        ends = more.join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("v").alias("root"), F.col("root").alias("top"))
        lone = joined.select(F.col("root").alias("v"), F.col("top").alias("root")).join(roots.select("v"), "v", "left_anti")
        roots = roots.join(joined, "root", "left").select("v", F.coalesce("top", "root").alias("root")).union(lone)
    # back to documents
    label = classes.join(roots, classes.vid == roots.v, "left").select("vid", F.coalesce("root", "vid").alias("root"), F.col("rep.doc_id").alias("rep_id"))
    tops = stored(label.groupBy("root").agg(F.min("rep_id").alias("component_id")))  # stored, so that the join may split a large root
    label = label.join(tops, "root").select("vid", "component_id")
    out = rows.join(label, "vid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("vid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "fp")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
