"""Bounded queries on the dependency graph. Edges: (run_id, source_file, target_file, ...), self-loops left out."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.staging import numbered, stored


def plain_edges(deps: DataFrame) -> DataFrame:
    return deps.where("source_file <> target_file").select(F.col("source_file").alias("src"), F.col("target_file").alias("dst")).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int = 5, backward: bool = False) -> DataFrame:
    """(start, file, distance): walks of 1 to ``depth`` edges from ``starts`` (file), each level deduplicated.

    A file is listed at every distance at which a walk ends in it. Starts whose walks
    end in the same files go on as one, as their further walks do too: on a dense
    graph these soon are few. Same means number and two 64-bit hashes, so that among n
    starts two that differ pass as one with a probability of about n ** 2 / 2 ** 129. A level
    is written in order of its starts, so that a task sees most repeats before they are shuffled.
    """
    e = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")) if backward else edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    e = stored(e.where("at is not null and next is not null").orderBy("at", "next"))
    onward = stored(e.join(e.select(F.col("next").alias("at")).distinct(), "at", "left_semi").select("at", "next"))  # what a second step can take
    members = stored(starts.select(F.col("file").alias("start"), F.col("file").alias("chief")).distinct())
    level = members.select("chief", F.col("chief").alias("at"))
    out = None
    for d in range(1, depth + 1):
        level = stored(level.join(e if d == 1 else onward, "at").select("chief", F.col("next").alias("at")).distinct().orderBy("chief", "at"))
        now = members.join(level, "chief").select("start", F.col("at").alias("file"), F.lit(d).alias("distance"))
        out = now if out is None else out.union(now)
        if d < depth:
            ends = stored(level.groupBy("chief").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("at")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "at")).alias("k")))
            alike = stored(ends.join(stored(ends.groupBy("n", "h", "k").agg(F.min("chief").alias("least"))), ["n", "h", "k"]).select("chief", "least"))
            members = stored(members.join(alike, "chief").select("start", F.col("least").alias("chief")))
            level = level.join(alike.where("chief = least"), "chief", "left_semi")
    return out


def nearest(reached: DataFrame) -> DataFrame:
    return reached.groupBy("start", "file").agg(F.min("distance").alias("distance"))


def trails(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, file, distance, path): edge-unique walks of 1 to ``depth`` edges. Their number grows with degree ** depth."""
    e = edges.select("src", "dst", F.concat_ws(">", "src", "dst").alias("edge"))
    level = starts.select(F.col("file").alias("start"), F.col("file").alias("at"), F.array().cast("array<string>").alias("used")).distinct()
    out = None
    for d in range(1, depth + 1):
        level = level.join(e, F.col("at") == F.col("src")).where(~F.array_contains("used", F.col("edge"))).select("start", F.col("dst").alias("at"), F.array_append("used", F.col("edge")).alias("used"))
        now = level.select("start", F.col("at").alias("file"), F.lit(d).alias("distance"), F.array_join("used", " ").alias("path"))
        out = now if out is None else out.union(now)
    return out


def least_reaching(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(file, label): the least vertex from which each of ``vertices`` (file) is reached over ``edges`` (src, dst), itself included.

    Labels move along edges, and each round also takes over the label of a label
    (who reaches my label reaches me), so a long path takes a number of rounds that
    grows with the logarithm of its length, unless names are in an adverse order.
    A round is written; joins read written tables, which adaptive execution may split.
    """
    now = stored(vertices.select("file", F.col("file").alias("label")))
    edges = edges.select(F.col("src").alias("file"), F.col("dst").alias("to"))
    while True:
        sent = edges.join(now, "file").groupBy(F.col("to").alias("file")).agg(F.min("label").alias("sent"))
        new = stored(now.join(sent, "file", "left").select("file", F.col("label").alias("old"), F.least("label", "sent").alias("label")))
        beyond = new.where("label <> file").select("label").distinct().join(new.select(F.col("file").alias("label"), F.col("label").alias("beyond")), "label")
        now = stored(new.join(beyond, "label", "left").select("file", "old", F.least("label", "beyond").alias("label")))
        if now.where("label <> old").isEmpty():
            return now.select("file", "label")
        now = now.select("file", "label")


#: Edges that one task finishes, as numbers: some 100 MB, whatever the input's size.
FEW = 4_000_000


def _coded(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vertices`` (file) with their place ``n`` by name, and ``edges`` (src, dst) as places (a, b), b null for an end not among them."""
    names = stored(numbered(vertices.select("file"), "file"))
    coded = edges.join(names.select(F.col("file").alias("src"), F.col("n").alias("a")), "src").join(names.select(F.col("file").alias("dst"), F.col("n").alias("b")), "dst", "left")
    return names, stored(coded.select("a", "b"))


def _in_one_task(coded: DataFrame, solve: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What ``solve`` makes of the columns of all ``coded`` edges (a, b; a missing end as 0), which one task takes in batches of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32) for c in (b.column(0), b.column(1))] for b in batches]
        if parts:
            found = solve(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            table = pa.table({k: pa.array(v) for k, v in found.items()})
            yield from table.to_batches(max_chunksize=100_000)

    return coded.coalesce(1).mapInArrow(run, schema)


def _ways(a: np.ndarray, b: np.ndarray, size: int) -> tuple[array, array]:
    """Edges by their first end: where each vertex's begin, and their other ends."""
    first = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=size)))).astype(np.int32)
    return array("i", first.tobytes()), array("i", b[np.argsort(a, kind="stable")].astype(np.int32).tobytes())


def _components_of(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Each vertex ``n`` with the least one of its component, ``least``, by depth-first searches without recursion."""
    size = int(max(a.max(), b.max())) + 1
    zeros = lambda: array("i", bytes(4 * size))
    first, ends = _ways(a, b, size)
    at, stack, order, seen = array("i", first), [], array("i"), bytearray(size)
    for v in np.unique(np.concatenate((a, b))).tolist():
        if seen[v]:
            continue
        seen[v] = 1
        stack.append(v)
        while stack:
            v = stack[-1]
            i, stop = at[v], first[v + 1]
            while i < stop and seen[ends[i]]:
                i += 1
            at[v] = i
            if i == stop:
                order.append(v)
                stack.pop()
            else:
                seen[ends[i]] = 1
                stack.append(ends[i])
    first, ends = _ways(b, a, size)
    least, seen = zeros(), bytearray(size)
    for v in reversed(order):
        if seen[v]:
            continue
        seen[v] = 1
        group, i = [v], 0
        while i < len(group):
            for w in ends[first[group[i]] : first[group[i] + 1]]:
                if not seen[w]:
                    seen[w] = 1
                    group.append(w)
            i += 1
        low = min(group)
        for w in group:
            least[w] = low
    n = np.sort(np.frombuffer(order, np.int32))
    return {"n": n.astype(np.int64), "least": np.frombuffer(least, np.int32)[n].astype(np.int64)}


def _levels_of(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Each vertex ``n`` from which no walk is endless (0 is never done), with the length ``level`` of its longest one."""
    size = int(max(a.max(), b.max())) + 1
    first, back = (np.frombuffer(x, np.int32) for x in _ways(b, a, size))
    left, level = np.bincount(a, minlength=size), np.full(size, -1, np.int32)
    met = np.bincount(b, minlength=size) + left > 0
    met[0] = False
    now, d = np.flatnonzero(met & (left == 0)), 0
    while len(now):
        level[now] = d
        sizes = first[now + 1] - first[now]
        places = np.repeat(first[now] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        sources, counts = np.unique(back[places], return_counts=True)
        left[sources] -= counts
        now, d = sources[left[sources] == 0], d + 1
    n = np.flatnonzero(level >= 0)
    return {"n": n.astype(np.int64), "level": level[n]}


def strong_components(edges: DataFrame, trims: int = 1, few: int = FEW) -> DataFrame:
    """(file, scc, size) of all ends of ``edges`` (src, dst): each strongly connected component, by its least file.

    Vertices without an edge in or out are components of their own and go first
    (``trims`` times). Of the others, two vertices of one component are reached from
    the same vertices, so have the same least one; within the vertices of one such
    label, those that also reach it are its component. What is left is labelled
    again, without the edges between labels. Once at most ``few`` edges are left, a
    number that does not grow with the input, one task finishes them, as numbers. Self-loops and
    null ends don't count; an empty table gives no row.
    """
    edges = stored(edges.where("src <> dst").select("src", "dst").distinct())
    left = stored(edges.select(F.col("src").alias("file")).union(edges.select("dst")).distinct())
    parts = []
    while not left.isEmpty():
        for _ in range(trims):
            through = edges.select(F.col("src").alias("file")).distinct().join(edges.select(F.col("dst").alias("file")).distinct(), "file", "left_semi")
            edges = stored(edges.join(through.withColumnRenamed("file", "src"), "src", "left_semi").join(through.withColumnRenamed("file", "dst"), "dst", "left_semi").select("src", "dst"))
        core = stored(edges.select(F.col("src").alias("file")).union(edges.select("dst")).distinct())
        parts.append(left.join(core, "file", "left_anti").select("file", F.col("file").alias("scc")))
        count = edges.count()
        if count == 0:
            break
        if count <= few:
            names, coded = _coded(edges, core)
            found = stored(_in_one_task(coded, _components_of, "n bigint, least bigint"))
            least = names.select(F.col("n").alias("least"), F.col("file").alias("scc"))
            parts.append(names.join(found, "n").join(least, "least").select("file", "scc"))
            break
        reached = least_reaching(edges, core)
        ends = edges.join(reached.select(F.col("file").alias("src"), F.col("label").alias("a")), "src").join(reached.select(F.col("file").alias("dst"), F.col("label").alias("b")), "dst")
        edges = stored(ends.where("a = b").select("src", "dst"))
        back = least_reaching(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), core).withColumnRenamed("label", "least")
        found = stored(reached.join(back, "file").select("file", F.when(F.col("label") == F.col("least"), F.col("label")).alias("scc")))
        parts.append(found.where("scc is not null"))
        left = stored(found.where("scc is null").select("file"))
        edges = stored(edges.join(left.withColumnRenamed("file", "src"), "src", "left_semi").join(left.withColumnRenamed("file", "dst"), "dst", "left_semi").select("src", "dst"))
    if not parts:
        return left.select("file", F.col("file").alias("scc"), F.lit(1).cast("bigint").alias("size"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = stored(out)
    return out.join(stored(out.groupBy("scc").agg(F.count("*").alias("size"))), "scc").select("file", "scc", "size")


def circular(components: DataFrame) -> DataFrame:
    """One row of components (file, scc, size): how many are circular, their files, and what they are, largest first: ``scc: size files``.

    The list is a row a circular component, and each names its least file only.
    """
    each = components.where("size > 1").groupBy("scc", "size").agg(F.count("*").alias("files"))
    named = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("s"), "scc"))), lambda x: F.concat(x["scc"], F.lit(": "), (-x["s"]).cast("string"), F.lit(" files")))
    return each.agg(F.count("*").alias("circular_components"), F.coalesce(F.sum("files"), F.lit(0)).alias("circular_files"), named.alias("circular_dependencies"))


def cycles(edges: DataFrame, depth: int = 10, limit: int | None = 50) -> DataFrame:
    """Trails of 2 to ``depth`` edges back to their start, shortest first; each rotation once for its start.

    A cycle stays in one strongly connected component, so only edges inside one are walked.
    A trail of d edges is one of the first half from its start, and one of the rest from
    where that ends, without a common edge: only halves are walked, so rows grow with
    degree ** (depth / 2) and with the trails found. With a ``limit``, longer trails are
    only looked for until that many are found.
    """
    edges = stored(edges.select("src", "dst"))
    home = strong_components(edges).where("size > 1")
    core = edges.join(home.select(F.col("file").alias("src"), F.col("scc").alias("a")), "src").join(home.select(F.col("file").alias("dst"), F.col("scc").alias("b")), "dst")
    core = stored(core.where("a = b").select("src", "dst"))
    e = core.select("src", F.col("dst").alias("to"), F.concat_ws(">", "src", "dst").alias("edge"))
    halves = {1: core.select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array(F.concat_ws(">", "src", "dst")).alias("used"))}
    out = None
    for d in range(2, depth + 1):
        more, rest = (d + 1) // 2, d // 2
        if more not in halves:
            longer = halves[more - 1].join(e, F.col("at") == F.col("src")).where(~F.array_contains("used", F.col("edge")))
            halves[more] = stored(longer.select("start", F.col("to").alias("at"), F.array_append("used", F.col("edge")).alias("used")))
        back = halves[rest].select(F.col("at").alias("start"), F.col("start").alias("at"), F.col("used").alias("then"))
        closed = halves[more].join(back, ["start", "at"]).where(~F.arrays_overlap("used", "then"))
        now = closed.select("start", F.lit(d).alias("length"), F.array_join(F.concat("used", "then"), " ").alias("path"))
        now = stored(now) if limit else now
        out = now if out is None else out.union(now)
        if limit and out.limit(limit).count() == limit:
            break
    return out.orderBy("length", "start", "path").limit(limit) if limit else out


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct in- and out-neighbours of each node (file), isolated ones too."""
    out_ = edges.groupBy(F.col("src").alias("file")).agg(F.countDistinct("dst").alias("outgoing"))
    in_ = edges.groupBy(F.col("dst").alias("file")).agg(F.countDistinct("src").alias("incoming"))
    both = nodes.select("file").distinct().join(out_, "file", "left").join(in_, "file", "left").na.fill(0, ["outgoing", "incoming"])
    return both.withColumn("total", F.col("incoming") + F.col("outgoing"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edge ends counted by node, with its importance and drawn size."""
    ends = edges.select(F.col("src").alias("file")).union(edges.select("dst")).groupBy("file").agg(F.count("*").alias("degree"))
    rank = F.when(F.col("degree") > 5, "Critical").when(F.col("degree") > 2, "Important").otherwise("Standard")
    return ends.withColumn("importance", rank).withColumn("size", 20 + 3 * F.col("degree"))


def levels(edges: DataFrame, nodes: DataFrame, few: int = FEW) -> DataFrame:
    """Dependency order (file, level, state): 0 for a file without dependencies, else one more than its deepest; null on and above cycles.

    state is ``ordered``, ``cycle`` for a file on a cycle, or ``waits`` for one that depends on such a file.

    While more than ``few`` edges wait, a round takes the files whose dependencies are
    all done; each is written, so that the next one's plan stays short. One task
    finishes the others, so that a deep chain is not as many rounds.
    """
    edges, files = stored(edges.select("src", "dst")), stored(nodes.select("file").distinct())
    new = stored(files.join(edges.select(F.col("src").alias("file")).distinct(), "file", "left_anti").withColumn("level", F.lit(0)))
    open_ = stored(edges.join(new.select(F.col("file").alias("dst")), "dst", "left_anti").select("src", "dst"))
    waiting = stored(edges.select("src").distinct())
    done, d = new, 0
    while not new.isEmpty():
        d += 1
        new = stored(waiting.join(open_.select("src").distinct(), "src", "left_anti").select(F.col("src").alias("file"), F.lit(d).alias("level")))
        done = done.union(new)
        waiting = stored(waiting.join(new.select(F.col("file").alias("src")), "src", "left_anti"))
        if open_.count() <= few:
            break
        open_ = stored(open_.join(new.select(F.col("file").alias("dst")), "dst", "left_anti"))
    if not new.isEmpty():
        # those that are done are ends without edges of their own here
        names, coded = _coded(open_, open_.select(F.col("src").alias("file")).union(new.select("file")).distinct())
        found = stored(_in_one_task(coded, _levels_of, "n bigint, level int"))
        done = done.union(names.join(found.where("level > 0"), "n").select("file", (F.col("level") + d).alias("level")))
    on = strong_components(open_, few=few).where("size > 1").select("file", F.lit(True).alias("on"))
    state = F.when(F.col("level").isNotNull(), "ordered").when(F.col("on"), "cycle").otherwise("waits")
    return files.join(done, "file", "left").join(on, "file", "left").select("file", "level", state.alias("state"))
