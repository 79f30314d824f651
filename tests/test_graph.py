"""Strongly connected components, circular lists, cycles and levels against brute force."""

import itertools
import random

import pytest

from codequarry import registry
from codequarry.operators import aggregates as A
from codequarry.operators import graph as G


def brute(edges):
    names = {v for e in edges for v in e}
    reach = {v: {v} for v in names}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    scc = {v: min(w for w in reach[v] if v in reach[w]) for v in names}
    size = {s: sum(x == s for x in scc.values()) for s in scc.values()}
    return {(v, s, size[s]) for v, s in scc.items()}


def ring(names):
    return list(zip(names, names[1:] + names[:1]))


NESTED = ring(["a", "b", "c", "d"]) + ring(["b", "x", "y"])  # two that share a file
CHAINED = ring(["p", "q", "r"]) + [("r", "s1")] + ring(["s1", "s2"]) + [("s2", "t")] + ring(["t", "u", "v", "w"]) + [("w", "end"), ("start", "p")]


def random_edges(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    return [e for e in {(rng.choice(names), rng.choice(names)) for _ in range(34)} if e[0] != e[1]]


@pytest.mark.parametrize("edges,few", [(NESTED + CHAINED, 0), (random_edges(1), 4), (random_edges(2), 20_000), ([(f"c{i:03}", f"c{i + 1:03}") for i in range(70)] + [("c070", "c000")] + NESTED, 20_000)])
def test_strong_components(spark, edges, few):
    df = spark.createDataFrame([*edges, edges[0], ("self", "self"), (None, "a")], "src string, dst string")
    assert {tuple(r) for r in G.strong_components(df, few=few).collect()} == brute(edges)


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert G.strong_components(none).count() == 0
    assert tuple(G.circular(G.strong_components(none)).first()) == (0, 0, [])


def test_circular_list(spark):
    deps = spark.createDataFrame([(1, a, b) for a, b in NESTED + CHAINED] + [(2, "a", "b")], "run_id long, source_file string, target_file string")
    r = A.dependency_metrics(deps, spark.createDataFrame([("p", "c.cpy")], "program string, copybook string")).first()
    assert (r.circular_components, r.circular_files) == (4, 15) and r.circular_dependencies == ["a: 6 files", "t: 4 files", "p: 3 files", "s1: 2 files"]
    assert [tuple(x) for x in A.run_circular(deps).collect()] == [(1, 4, 15)]


def test_cycles_stay_in_their_component(spark):
    df = spark.createDataFrame(CHAINED, "src string, dst string")
    got = {(r.start, r.length) for r in G.cycles(df, limit=None).where("length <= 4").collect()}
    want = {(v, 3) for v in "pqr"} | {("s1", 2), ("s2", 2), ("s1", 4), ("s2", 4)} | {(v, 4) for v in "tuvw"}
    assert got == want - {("s1", 4), ("s2", 4)}  # a trail takes an edge once


def test_only_halves_of_cycles_are_walked(spark, monkeypatch):
    edges = [(a, b) for a in "abcde" for b in "abcde" if a != b]
    now, want = [[e] for e in edges], set()
    for d in range(2, 7):
        now = [[*t, e] for t in now for e in edges if e[0] == t[-1][1] and e not in t]
        want |= {(t[0][0], d, " ".join(f"{a}>{b}" for a, b in t)) for t in now if t[0][0] == t[-1][1]}
    sizes, stored = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df: (out := stored(df), sizes.append(out.count()))[0])
    got = [tuple(r) for r in G.cycles(spark.createDataFrame(edges, "src string, dst string"), depth=6, limit=10**6).collect()]
    assert sorted(got) == sorted(want) and got == sorted(got, key=lambda r: (r[1], r[0], r[2]))
    assert max(sizes) < len(now) / 3


def test_levels_tell_cycles_from_what_waits_for_them(spark):
    df = spark.createDataFrame([*CHAINED, ("top", "end")], "src string, dst string")
    names = spark.createDataFrame([(v,) for v in set(itertools.chain(*CHAINED)) | {"top"}], "file string")
    got = {r.file: (r.level, r.state) for r in G.levels(df, names).collect()}
    assert got["end"] == (0, "ordered") and got["top"] == (1, "ordered") and got["start"] == (None, "waits") and got["t"] == (None, "cycle")


def longest_walks(edges):
    """Length of each vertex's longest walk, null if one is endless."""
    ways = {}
    for a, b in edges:
        ways.setdefault(a, set()).add(b)
    level = {v: 0 for v in set(itertools.chain(*edges)) - set(ways)}
    while new := {v: 1 + max(level[w] for w in to) for v, to in ways.items() if v not in level and to <= set(level)}:
        level |= new
    return {v: level.get(v) for v in itertools.chain(*edges)}


@pytest.mark.parametrize("few", [0, 7, 10**6])
def test_levels_in_rounds_and_in_one_task(spark, few):
    rng = random.Random(few)
    edges = [*CHAINED, *{(f"d{a}", f"d{b}") for a, b in (sorted((rng.randrange(20), rng.randrange(20))) for _ in range(30)) if a < b}, ("u0", "d0"), ("u1", "p")]
    df = spark.createDataFrame(edges, "src string, dst string")
    names = spark.createDataFrame([(v,) for v in {*itertools.chain(*edges), "alone"}], "file string")
    got = {r.file: r.level for r in G.levels(df, names, few=few).collect()}
    assert got == longest_walks(edges) | {"alone": 0}


def test_deep_levels_and_components_take_few_jobs(spark):
    n = 3000
    chain = spark.range(n).selectExpr("'c' || id src", "'c' || (id + 1) dst")
    ring = spark.range(30_000).selectExpr("'r' || id src", f"'r' || (id + 1) % 30000 dst")
    names = chain.union(ring).selectExpr("explode(array(src, dst)) file").distinct()
    status = spark.sparkContext.statusTracker()
    before = max(status.getJobIdsForGroup(None), default=0)
    got = G.levels(chain.union(ring), names).groupBy("state").agg({"level": "max", "*": "count"}).collect()
    assert sorted((r.state, r["max(level)"], r["count(1)"]) for r in got) == [("cycle", None, 30_000), ("ordered", n, n + 1)]
    assert max(status.getJobIdsForGroup(None)) - before < 200


def walks(edges, starts, depth=5):
    now, found = {(s, s) for s in starts}, set()
    for d in range(1, depth + 1):
        now = {(s, b) for s, v in now for a, b in edges if a == v}
        found |= {(s, b, d) for s, b in now}
    return found


@pytest.mark.parametrize("edges", [NESTED + CHAINED, random_edges(3), [(f"u{i}", f"t{k}") for i in range(12) for k in range(5) if i % 3 != k] + [(f"t{k}", f"t{(k + s) % 5}") for k in range(5) for s in (1, 2)]])
@pytest.mark.parametrize("backward", [False, True])
def test_reach_like_brute_force(spark, edges, backward):
    df, ways = spark.createDataFrame([*edges, edges[0]], "src string, dst string"), {(b, a) if backward else (a, b) for a, b in edges}
    starts = df.select(df.src.alias("file")).union(df.select("dst"))
    assert sorted(tuple(r) for r in G.reach(df, starts, backward=backward).collect()) == sorted(walks(ways, {v for e in edges for v in e}))


EVENTS = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 101), (5, 5), (6, None), (7, 2), (100, 7), (7, 2)]


@pytest.mark.parametrize("name", ["g2_dependencies_pairs", "g2_impact_pairs", "g2_min_distance"])
def test_every_file_is_a_start(spark, tmp_path, name):
    spark.createDataFrame([(i, u, "view", None if k is None else f'{{"k": {k}}}') for i, (u, k) in enumerate(EVENTS)], "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    edges = {(f"f{u}", f"f{k}") for u, k in EVENTS if k is not None and u != k}
    want = walks({(b, a) for a, b in edges}, {b for _, b in edges}) if name == "g2_impact_pairs" else walks(edges, {a for a, _ in edges})
    if name == "g2_min_distance":
        want = {(s, f, min(d for t, g, d in want if (s, f) == (t, g))) for s, f, _ in want}
    assert sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(want)
