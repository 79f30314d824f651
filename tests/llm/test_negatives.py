"""Hard negatives against brute force: ties, repeated rows and ids, hot vectors, short and long components, rounds and blocks of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import negatives

ROWS = "id long, label long, v array<long>"


def brute(rows, anchor, positives=5, wanted=10, low=30, high=90):
    rows = [r for r in rows if None not in r]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (qid, label, q) in enumerate(rows):
        if not anchor(qid):
            continue
        scored = [(-dot(q, v), vid, lab) for j, (vid, lab, v) in enumerate(rows) if j != i]
        for s, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:wanted]
            out += [(qid, pid, k, nid, -s, -t) for k, (t, nid, _) in enumerate(fits, 1)]
    return sorted(out)


def random_rows(seed, n=150, dim=4, size=6):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 3), [rng.randint(-size, size) for _ in range(dim)]) for i in range(n)]
    hot = [(1000 + i, 1 + i % 2, [size] * dim) for i in range(60)]
    odd = [(7, 2, [1, 2]), (7, 2, [1, 2]), (10, 0, [0] * dim), (20, 0, []), (None, 1, [1] * dim), (30, None, [1] * dim), (40, 3, None), (1000, 1, [size] * dim)]
    return rows + hot + odd


@pytest.mark.parametrize("seed,size,options", [(1, 6, {}), (2, 3, {"block": 4, "first": 5, "cuts": 7}), (3, 400, {"block": 16, "first": 1, "pivots": 9}), (4, 10**8, {"block": 8, "first": 20, "cuts": 1})])
def test_like_brute_force(spark, seed, size, options):
    rows = random_rows(seed, size=size)
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as cid", "'x' as block")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0, **options).collect())
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert got


def test_queries_are_shipped_by_tile(spark, monkeypatch):
    """One interval over many blocks and tiles: a query goes to a tile once, whatever the tile's blocks."""
    tables, stored = [], negatives.stored
    monkeypatch.setattr(negatives, "stored", lambda df: (out := stored(df), tables.append(out))[0])
    rows = random_rows(6, n=300)
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") % 50 == 0, pivots=1, cuts=1, block=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 50 == 0)
    blocks = next(t for t in tables if "block" in t.columns).count()
    dealt = [t.groupBy("tile", "qid").count().agg(F.count("*").alias("pairs"), F.max("count").alias("most"), F.countDistinct("tile").alias("tiles")).first() for t in tables if "tile" in t.columns]
    assert dealt and max(d.most for d in dealt) == 1 and 1 < max(d.tiles for d in dealt) < blocks / 2


def test_other_numbers_of_results(spark):
    rows = random_rows(5)
    got = negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") < 20, positives=2, negatives=3, low=0, high=100, block=32, first=40).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i < 20, 2, 3, 0, 100)


def test_without_results(spark):
    for rows in ([], [(0, 1, [1, 2])], [(0, 1, [1, 2]), (1, 1, [1, 2])], [(0, 1, [1, 2]), (1, 2, [1, 2])], [(0, 1, [1, 0]), (1, 1, [-1, 0]), (2, 2, [-1, 0])]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, ROWS), F.col("id") == 0).count() == 0


def test_what_is_usable(spark):
    rows = [(0, [1.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("-inf"), 1.0]), (5, [])]
    got = spark.createDataFrame(rows, "id long, v array<float>").where(negatives.usable(F.col("v"))).select("id").collect()
    assert sorted(r.id for r in got) == [0, 5]


def test_bounds_leave_nothing_out(spark):
    """A round that scans one interval more at a time gives what all at once give."""
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), rng.integers(-50, 50, 8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, ROWS)
    one = negatives.hard_negatives(df, F.col("id") % 50 == 0, block=8, first=1)
    assert sorted(tuple(r) for r in one.collect()) == brute(rows, lambda i: i % 50 == 0)
