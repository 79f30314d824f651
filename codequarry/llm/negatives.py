"""Hard negatives by inner product over one-dimensional distance keys.

A vector x gets one more component, sqrt(M**2 - |x|**2) for the largest length M,
a query gets 0: then |q - x|**2 = |q|**2 + M**2 - 2 q.x, and the highest inner
products are the least distances. Each vector goes to its nearest pivot and is
stored sorted by (pivot, distance to it), cut into intervals of that key.

By the triangle inequality an interval [a, b] of a pivot at distance d from the
query holds only distances from max(a - d, d - b, 0) to d + b. A search scans
intervals in the order of that least distance, from the annulus's inner radius on
where scores are bounded above, in rounds of growing numbers of vectors, until the
least distance of all intervals left is beyond what the k-th result, or the lower
bound of the scores, asks for. Results are exact: scores are integers, distances
only decide what may be left out, with a margin far above their rounding.

Equal vectors of one label are one entry with its least ids; queries that are
equal are searched once. Entries are stored in blocks, blocks gathered to tiles of at
most 65,536 entries, queries dealt in chunks of about as many; a task takes a chunk's
queries and a tile's blocks that they visit. So what is shipped is the entries
once for each chunk and the queries once for each tile, and not for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.shared import stored

_LOWEST, _HIGHEST = -(2**62), 2**62


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    if len(values) == len(column) * dim:
        return values.reshape(len(column), dim)
    out = np.zeros((len(column), dim), dtype=values.dtype)
    for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
        out[i, : b - a] = values[a:b]
    return out


class _Space:
    """Pivots, and the bounds that distances to them give."""

    def __init__(self, dim: int, longest: float, largest: float) -> None:
        self.dim, self.square = dim, longest
        self.slack = 1e-6 * longest**0.5 + 1e-9
        self.kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"
        # sums of products of whole numbers below 2**24 and 2**53 are exact in floating point
        self.short, self.exact = (dim * largest**2 < 2**n for n in (24, 53))
        self.pivots = np.zeros((1, dim + 1))

    def augmented(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(0, self.square - np.einsum("ij,ij->i", x, x)))
        return np.concatenate((x, rest[:, None]), axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Of augmented points to all pivots."""
        square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots) - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def fit(self, sample: np.ndarray, count: int) -> None:
        """Pivots as means of a sample's groups."""
        points = self.augmented(sample)
        self.pivots = points[np.unique(np.linspace(0, len(points) - 1, count).astype(int))]
        for _ in range(8):
            near = self.distances(points).argmin(axis=1)
            self.pivots = np.array([points[near == p].mean(axis=0) if (near == p).any() else self.pivots[p] for p in range(len(self.pivots))])

    def radius(self, norm: float, score: float) -> float:
        """Distance at which a score lies."""
        return max(0.0, norm + self.square - 2 * score) ** 0.5

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.short:
            return np.rint(q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
        if self.exact:
            return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T


class Index:
    """Entries stored by (pivot, distance), in blocks; ``intervals`` is a row for each of at most pivots x cuts intervals of the key."""

    def __init__(self, entries: DataFrame, pivots: int, cuts: int, block: int, sample: int) -> None:
        """``entries`` are stored (cid, label, v, ids). ``sample`` of them, those of the least hashes, fit the pivots; all are indexed."""
        size = lambda f: F.coalesce(F.max(f), F.lit(0))
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        self.count, dim, longest, largest = entries.agg(F.count("*"), size(F.size("v")), size(square), size(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))).first()
        self.space, least = _Space(dim, float(longest), float(largest)), max(1, block // 4)
        if self.count:
            rows = [r.v for r in entries.orderBy(F.xxhash64("cid")).limit(sample).select("v").collect()]
            self.space.fit(_matrix(pa.array(rows, pa.list_(pa.int64())), dim), min(pivots, -(-self.count // least)))
        space = self.space

        def placed(edges: list[list[float]] | None):
            first = np.cumsum([0, *(len(e) + 1 for e in edges)]) if edges else None

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = _matrix(b.column(2), space.dim)
                    far = space.distances(space.augmented(x))
                    pivot = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
                    dist = far[np.arange(len(far)), pivot]
                    if edges is None:
                        yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(dist)], names=["pivot", "dist"])
                        continue
                    at = first[pivot] + np.array([np.searchsorted(edges[p], d) for p, d in zip(pivot.tolist(), dist.tolist())], dtype=np.int64)
                    packed = [row.tobytes() for row in x.astype(space.kind)]
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dist), b.column(0), b.column(1), b.column(3), pa.array(packed, pa.binary())], names=["interval", "dist", "cid", "label", "ids", "v"])

            return run

        marks = [i / cuts for i in range(1, cuts)]
        keyed = entries.select("cid", "label", "v", "ids")
        by_pivot = keyed.mapInArrow(placed(None), "pivot bigint, dist double").groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", marks or [0.5], 1000).alias("at")).collect()
        edges: list[list[float]] = [[] for _ in self.space.pivots]
        for r in by_pivot:
            step = max(1, cuts // max(1, min(cuts, r.n // least)))
            edges[r.pivot] = sorted(set(r["at"][step - 1 :: step])) if marks and r.n > least else []
        owner = np.repeat(np.arange(len(edges)), [len(e) + 1 for e in edges])
        rows = keyed.mapInArrow(placed(edges), "interval bigint, dist double, cid bigint, label bigint, ids array<bigint>, v binary")

        def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, made, held = TaskContext.get().partitionId() << 33, 0, None

            def closed(x: pd.DataFrame) -> pd.DataFrame:
                # in order of the least ids, by which ties go
                x = x.iloc[np.argsort([i[0] for i in x["ids"]], kind="stable")]
                row = {"interval": x["interval"].iloc[0], "block": place + made, "low": x["dist"].min(), "high": x["dist"].max(), "n": len(x), "cids": x["cid"].to_numpy(np.int64).tobytes(), "labels": x["label"].to_numpy(np.int64).tobytes(), "v": b"".join(x["v"]), "sizes": np.array([len(i) for i in x["ids"]], dtype=np.int64).tobytes(), "ids": np.concatenate(x["ids"].to_list()).astype(np.int64).tobytes()}
                return pd.DataFrame([row])

            for pdf in batches:
                for _, x in pdf.groupby("interval", sort=False):
                    if held is not None and held["interval"].iloc[0] != x["interval"].iloc[0]:
                        yield closed(held)
                        made, held = made + 1, None
                    held = x if held is None else pd.concat((held, x))
                    while len(held) >= block:
                        yield closed(held.iloc[:block])
                        made, held = made + 1, held.iloc[block:] if len(held) > block else None
                        if held is None:
                            break
            if held is not None:
                yield closed(held)

        order = ["interval", "dist", "cid"]
        self.blocks = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(packs, "interval bigint, block bigint, low double, high double, n bigint, cids binary, labels binary, v binary, sizes binary, ids binary"))
        found = self.blocks.groupBy("interval").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("interval").toPandas()
        self.intervals = {"interval": found["interval"].to_numpy(np.int64), "pivot": owner[found["interval"].to_numpy(np.int64)], "low": found["low"].to_numpy(), "high": found["high"].to_numpy(), "n": found["n"].to_numpy()}
        # intervals are gathered to tiles, and one that is larger is split into several
        tile, now, filled = min(65_536, max(block, -(-self.count // 32))), 0, 0
        base, splits = np.zeros(len(found), np.int64), np.ones(len(found), np.int64)
        for i, n in enumerate(self.intervals["n"].tolist()):
            splits[i] = -(-n // tile)
            if filled and filled + n > tile:
                now, filled = now + 1, 0
            base[i] = now
            if splits[i] > 1:
                now, filled = now + splits[i], 0
            else:
                filled += n
        self.tiles = base, splits

    def search(self, queries: DataFrame, same: bool, k: int, chunk: int = 65_536, first: int = 2048) -> DataFrame:
        """(qid, band, score, id, cid): the first k rows of each band of each query, highest scores first, ties by id.

        ``queries`` are (qid, label, v, lows, highs): a band takes scores from its low to
        its high, both included. ``same`` takes rows of the query's label, else those of
        other labels. ``first`` is the number of entries that the first round scans; each
        next one scans eight times as many. A round's table is written, so a lost executor
        costs a part of one round.
        """
        space, it, base, splits = self.space, self.intervals, *self.tiles
        kind = "qid bigint, label bigint, v array<bigint>, lows array<bigint>, highs array<bigint>, seen int, over boolean"

        def ordered(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
            """Each query's place, the intervals it may scan by least distance, these distances and the one beyond which none counts."""
            q = _matrix(b.column("v"), space.dim)
            norms = np.einsum("ij,ij->i", q.astype(np.float64), q.astype(np.float64))
            far = space.distances(np.concatenate((q.astype(np.float64), np.zeros((len(q), 1))), axis=1))
            for i, (norm, d, lows, highs) in enumerate(zip(norms.tolist(), far, b.column("lows").to_pylist(), b.column("highs").to_pylist())):
                d = d[it["pivot"]]
                inner = space.radius(norm, max(highs)) - space.slack
                near, most = np.maximum(np.maximum(it["low"] - d, d - it["high"]), inner), d + it["high"]
                order = np.argsort(near, kind="stable")
                order = order[most[order] + space.slack >= inner]
                yield i, order, near[order], space.radius(norm, min(lows)) + space.slack

        def planned(wanted: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    upto, over, before = [], [], b.column("seen").to_pylist()
                    for i, order, near, outer in ordered(b):
                        seen, asked = before[i], int(np.searchsorted(near, outer, "right"))  # beyond, nothing is near enough
                        last = max(seen, min(asked, seen + 1 + int(np.searchsorted(np.cumsum(it["n"][order[seen:]]), wanted))))
                        upto.append(last)
                        over.append(last >= asked)
                    cols = [b.column(c) for c in ("qid", "label", "v", "lows", "highs", "seen")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(upto, pa.int32()), pa.array(over, pa.bool_())], names=["qid", "label", "v", "lows", "highs", "was", "seen", "over"])

            return run

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and tile that it visits, with its intervals there; the order of intervals is that of the plan."""
            names = ["qid", "label", "lows", "highs"]
            for whole in batches:
                for begin in range(0, len(whole), 64):
                    b = whole.slice(begin, 64)
                    packed = _matrix(b.column("v"), space.dim).astype(np.int64)
                    was, seen, at, tiles, visits = b.column("was").to_pylist(), b.column("seen").to_pylist(), [], [], []
                    for i, order, _, _ in ordered(b):
                        new = np.sort(order[was[i] : seen[i]])
                        tile = np.repeat(base[new], splits[new]) + np.concatenate([np.arange(n) for n in splits[new].tolist()] or [np.zeros(0, np.int64)])
                        new = np.repeat(new, splits[new])
                        by_tile = np.argsort(tile, kind="stable")
                        tile, new = tile[by_tile], it["interval"][new[by_tile]]
                        cuts = np.flatnonzero(np.diff(tile)) + 1
                        for part in np.split(np.arange(len(tile)), cuts) if len(tile) else []:
                            at.append(i)
                            tiles.append(int(tile[part[0]]))
                            visits.append(new[part].astype("<i4").tobytes())
                    rows = b.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), *[rows.column(n) for n in names], pa.array([packed[i].tobytes() for i in at], pa.binary()), pa.array(visits, pa.binary())], names=["tile", *names, "v", "visits"])

        def cut(q: np.ndarray, score: np.ndarray, ident: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
            """The first k of each query by score, then id."""
            order = np.lexsort((ident, -score, q))
            first = np.searchsorted(q[order], q[order], "left")
            order = order[np.arange(len(order)) - first < k]
            return [x[order] for x in (q, score, ident, *rest)]

        def scanned(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = ["qid", "band", "score", "id", "cid"]
            if not len(left) or not len(right):
                return pd.DataFrame(columns=columns)
            q = np.frombuffer(b"".join(left["v"]), np.int64).reshape(len(left), space.dim)
            label, many = left["label"].to_numpy(np.int64), max(map(len, left["lows"]))
            # a band that a query lacks takes nothing
            lows, highs = np.full((len(left), many), _HIGHEST), np.full((len(left), many), _LOWEST)
            for i, (low, high) in enumerate(zip(left["lows"], left["highs"])):
                lows[i, : len(low)], highs[i, : len(high)] = low, high
            visits = [np.frombuffer(v, "<i4") for v in left["visits"]]
            who, where = np.repeat(np.arange(len(left)), [len(v) for v in visits]), np.concatenate(visits)
            by_interval = np.argsort(where, kind="stable")
            who, where = who[by_interval], where[by_interval]
            kept: list[list[np.ndarray]] = [[np.zeros(0, np.int64) for _ in range(5)] for _ in range(many)]  # query, score, least id, block, entry
            held = []
            for number, b in enumerate(right.itertuples(index=False)):
                labels, sizes, ids = np.frombuffer(b.labels, np.int64), np.frombuffer(b.sizes, np.int64), np.frombuffer(b.ids, np.int64)
                starts, x = np.cumsum(sizes) - sizes, np.frombuffer(b.x, space.kind).reshape(int(b.n), space.dim)
                held.append((np.frombuffer(b.cids, np.int64), sizes, ids, starts))
                asking = who[np.searchsorted(where, b.interval, "left") : np.searchsorted(where, b.interval, "right")]
                for begin in range(0, len(asking), 256):
                    some = asking[begin : begin + 256]
                    scores = space.products(q[some], x)
                    fits = ((label[some][:, None] == labels) == same) & (scores >= lows[some].min(axis=1)[:, None]) & (scores <= highs[some].max(axis=1)[:, None])
                    row, entry = np.nonzero(fits)
                    score = scores[row, entry]
                    for band in range(many):
                        takes = (score >= lows[some[row], band]) & (score <= highs[some[row], band])
                        if not takes.any():
                            continue
                        # the order within a block is that of the ids
                        one = cut(some[row[takes]], score[takes], ids[starts[entry[takes]]], [np.full(int(takes.sum()), number), entry[takes]])
                        mine = np.isin(kept[band][0], some)
                        both = cut(*[np.concatenate((old[mine], new)) for old, new in zip(kept[band][:3], one[:3])], [np.concatenate((old[mine], new)) for old, new in zip(kept[band][3:], one[3:])])
                        kept[band] = [np.concatenate((old[~mine], new)) for old, new in zip(kept[band], both)]
                        # with k entries, none below the last of them is asked for
                        full, last, times = np.unique(both[0], return_index=True, return_counts=True)
                        full, last = full[times == k], (last + times - 1)[times == k]
                        lows[full, band] = np.maximum(lows[full, band], both[1][last])
            out = []
            qids = left["qid"].to_numpy(np.int64)
            for band, (asker, score, _, number, entry) in enumerate(kept):
                for i in np.unique(number).tolist():
                    cids, sizes, ids, starts = held[i]
                    at = number == i
                    e = entry[at]
                    each = np.repeat(np.arange(len(e)), sizes[e])
                    place = np.arange(len(each)) - np.repeat(np.cumsum(sizes[e]) - sizes[e], sizes[e]) + starts[e][each]
                    out.append((asker[at][each], np.full(len(each), band), score[at][each], ids[place], cids[e][each]))
            if not out:
                return pd.DataFrame(columns=columns)
            asker, band, score, ident, cid = (np.concatenate(x) for x in zip(*out))
            # of the first k entries, the first k ids
            _, score, ident, asker, band, cid = cut(asker * many + band, score, ident, [asker, band, cid])
            return pd.DataFrame({"qid": qids[asker], "band": band.astype(np.int32), "score": score, "id": ident, "cid": cid})

        by = Window.partitionBy("qid", "band").orderBy(F.desc("score"), "id", "cid")
        found, open_, wanted = None, queries.withColumns({"seen": F.lit(0), "over": F.lit(False)}).select(*[x.split()[0] for x in kind.split(", ")]), first
        chunks = -(-queries.count() // chunk)
        places = queries.sparkSession.createDataFrame([(int(i), int(t), int(n)) for i, t, n in zip(it["interval"], base, splits)], "interval bigint, base bigint, splits bigint")  # at most pivots x cuts
        blocks = self.blocks.join(F.broadcast(places), "interval").withColumn("t", F.col("base") + F.pmod("block", "splits"))
        while True:
            plan = stored(open_.mapInArrow(planned(wanted), kind.replace("seen int", "was int, seen int")))
            rows = plan.mapInArrow(dealt, "tile bigint, qid bigint, label bigint, lows array<bigint>, highs array<bigint>, v binary, visits binary")
            rows = stored(rows.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(max(1, chunks)))))
            pairs = rows.select(F.col("tile").alias("t"), F.col("chunk").alias("c")).distinct()
            right = blocks.join(pairs, "t").select("t", "c", "interval", "block", "n", "cids", "labels", F.col("v").alias("x"), "sizes", "ids")
            rows = rows.groupBy("tile", "chunk").cogroup(right.groupBy("t", "c")).applyInPandas(scanned, "qid bigint, band int, score bigint, id bigint, cid bigint")
            rows = rows if found is None else found.union(rows)
            found = stored(rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k))
            if plan.where("not over").isEmpty():
                return found.drop("r")
            # a band with k results asks for none below the last of them
            last = found.where(F.col("r") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("last"))
            raised = F.transform("lows", lambda low, i: F.greatest(low, F.coalesce(F.try_element_at("last", i), low)))
            open_ = plan.where("not over").drop("was").join(last, "qid", "left").withColumn("lows", raised).drop("last")
            found, wanted = found.drop("r"), wanted * 8


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = 64, cuts: int = 64, block: int = 4096, sample: int = 4096, first: int = 2048) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (id, label, v: array of bigint).

    Rows of which ``anchor`` holds are anchors. Their positives are the first
    ``positives`` other rows of their label by score, ties by id; for each, the first
    ``negatives`` rows of other labels with low * p <= 100 * s <= high * p for the
    positive's score p. An anchor without positives, or a positive without such rows
    (any of a score below 0), gives no row.

    Rows with a null id, label or vector take no part; components are not null.
    Repeated rows, and rows of one id, count one by one; shorter vectors count as
    filled up with zeros; an empty table gives no row. Scores must fit in 64 bits.
    """
    vectors = vectors.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("id is not null and label is not null and v is not null")
    keep = max(positives + 1, negatives)
    ranked = vectors.withColumn("r", F.row_number().over(Window.partitionBy("label", "v").orderBy("id"))).where(F.col("r") <= keep)
    entries = stored(ranked.groupBy("label", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()))
    index = Index(entries, pivots, cuts, block, sample)
    asking = stored(vectors.where("anchor").select("id", "label", "v").join(entries.select("label", "v", "cid"), ["label", "v"]).select("id", "cid"))
    queries = entries.join(asking.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "label", "v", (F.size("ids") > 1).alias("many"))
    queries = stored(queries)
    bound = lambda x: F.array(F.lit(x).cast("bigint"))
    near = index.search(queries.select("qid", "label", "v", bound(_LOWEST).alias("lows"), bound(_HIGHEST).alias("highs")), True, positives + 1, first=first)
    near = near.join(queries.select("qid", "many"), "qid").where("many or cid <> qid")
    near = stored(near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "cid"))), lambda x: F.struct((-x["s"]).alias("score"), x["id"].alias("id"), x["cid"].alias("cid"))).alias("positives")))
    wanted = F.array_sort(F.array_distinct(F.transform(F.filter("positives", lambda x: x["score"] >= 0), lambda x: x["score"])))
    # whole numbers: from the smallest s with low * p <= 100 * s to the largest with 100 * s <= high * p
    bands = near.select("qid", wanted.alias("p")).where(F.size("p") > 0)
    bands = stored(bands.withColumns({"lows": F.expr(f"transform(p, x -> ({low} * x + 99) div 100)"), "highs": F.expr(f"transform(p, x -> ({high} * x) div 100)")}))
    far = index.search(queries.select("qid", "label", "v").join(bands.select("qid", "lows", "highs"), "qid"), False, negatives, first=first)
    by_band = far.groupBy("qid", "band").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), lambda x: F.struct(x["id"].alias("id"), (-x["s"]).alias("score"))).alias("rows"))
    by_score = by_band.join(bands.select("qid", "p"), "qid").groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.element_at("p", F.col("band") + 1), "rows"))).alias("found"))
    answers = near.join(by_score, "qid")
    # an anchor's own row goes, once
    own = F.array_position(F.transform("positives", lambda x: F.when((x["cid"] == F.col("qid")), x["id"]).otherwise(F.lit(None))), F.col("anchor_id"))
    others = F.slice(F.filter("positives", lambda x, i: i != own - 1), 1, positives)
    out = asking.select(F.col("cid").alias("qid"), F.col("id").alias("anchor_id")).join(answers, "qid").select("anchor_id", "found", F.explode(others).alias("p"))
    out = out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.try_element_at("found", F.col("p.score"))).alias("i", "n"))
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) v, row_number() over () r
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, a.r, b.vec_id other, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score from e a join e b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select anchor_id, r, other positive_id, score positive_score, row_number() over (partition by r order by score desc, other) k from s where same qualify k <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.r, p.k order by s.score desc, s.other)::int as rank, s.other negative_id, positive_score, s.score negative_score
from p join s on s.r = p.r and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score qualify rank <= 10"""
