"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their first four and five bytes, each
as a 64-bit hash. The machine's score is
w0 + sum w_i + 1/2 sum_f ((sum v_if)**2 - sum v_if**2)
over the terms of its dictionary, so that pairs of terms weigh in beyond what
each adds alone, and the logistic function turns it into 0 to 1. Terms enter the
dictionary for what they say alone or for what a pair says beyond its terms. The
machine is fitted by Adagrad on a bounded sample of labelled rows; scoring covers
every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.textscan import slices

_SALT = {4: np.uint64(0x51ED270B0B5F1D5B), 5: np.uint64(0xA24BAED4963EE407)}


def hashed_terms(texts: pa.Array):
    """The distinct term hashes of each text; none for a null or blank one."""
    for _, _, scan in slices(texts):
        scan.words()
        sums, size = scan.sums(), scan.end - scan.start
        parts = [scan.hashes(sums, scan.start, scan.end)]
        parts += [scan.hashes(sums, scan.start, scan.start + np.minimum(size, n)) ^ salt for n, salt in _SALT.items()]
        bounds = scan.word_off.tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield np.unique(np.concatenate([p[a:b] for p in parts]))


@dataclass
class Machine:
    """``terms`` is sorted; weights of terms[i] are w[i] and v[i]."""

    terms: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the dictionary, and each text's first of them (and the end)."""
        sizes = np.array([len(f) for f in found])
        flat = np.concatenate([*found, np.zeros(0, np.uint64)])
        row = np.repeat(np.arange(len(found)), sizes)
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(len(found) + 1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        known = self.terms[at] == flat
        return at[known], np.concatenate(([0], np.cumsum(np.bincount(row[known], minlength=len(found)))))

    def raw(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        def total(x: np.ndarray) -> np.ndarray:
            c = np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)))
            return c[off[1:]] - c[off[:-1]]

        v = self.v[at]
        return self.w0 + total(self.w[at]) + 0.5 * (total(v) ** 2 - total(v * v)).sum(axis=1)

    def score(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(at, off), -30, 30)))


def _alone(count: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Standard errors by which the share of toxic texts with each term lies off that of all texts."""
    return (toxic - count * share) / np.sqrt(count * share * (1 - share))


def _together(at: np.ndarray, off: np.ndarray, terms: int, error: np.ndarray, spread: np.ndarray, away: float, support: int, width: int = 512) -> np.ndarray:
    """Terms (places) with a partner such that the texts that hold both are ``away`` standard errors off what is expected of them.

    ``error`` is label less expectation by text, ``spread`` its variance. All pairs of the given terms are
    looked at, ``width`` times ``width`` at once by matrix products. Of terms that stand in the same texts one is kept.
    """
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    mark = np.zeros(terms, dtype=np.uint64)
    np.add.at(mark, at, np.random.default_rng(3).integers(0, 1 << 63, n, dtype=np.uint64)[row])
    _, first = np.unique(mark, return_index=True)
    place = np.full(terms, -1)
    place[first] = np.arange(len(first))
    kept = place[at] >= 0
    row, col = row[kept], place[at[kept]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]

    def block(i: int) -> np.ndarray:
        a, b = np.searchsorted(col, (i, i + width))
        out = np.zeros((n, min(width, len(first) - i)), dtype=np.float32)
        out[row[a:b], col[a:b] - i] = 1
        return out

    hit = np.zeros(len(first), dtype=bool)
    for i in range(0, len(first), width):
        left = block(i).T
        less, var = left * error.astype(np.float32), left * spread.astype(np.float32)
        for j in range(i, len(first), width):
            right = block(j)
            found = (np.abs(less @ right) >= away * np.sqrt(np.maximum(var @ right, 1.0))) & (left @ right >= support)
            if i == j:
                np.fill_diagonal(found, False)
            hit[i : i + width] |= found.any(axis=1)
            hit[j : j + width] |= found.any(axis=0)
    return first[hit]


def _fitted(m: Machine, found: list[np.ndarray], labels: np.ndarray, steps: int, rate: float, decay: float, batch: int, rng: np.random.Generator) -> Machine:
    """Adagrad over at least ``steps`` batches; small samples are worked through again and again."""
    factors = m.v.shape[1]
    at, off = m.rows(found)
    gw, gv, g0 = np.full(len(m.terms), 1e-2, np.float32), np.full(m.v.shape, 1e-2, np.float32), 1e-2
    for _ in range(max(1, -(-steps * batch // max(1, len(labels))))):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            size = off[rows + 1] - off[rows]
            places = np.concatenate([at[off[r] : off[r + 1]] for r in rows])
            here = np.concatenate(([0], np.cumsum(size)))
            err = (m.score(places, here) - labels[rows]) / len(rows)
            used, where = np.unique(places, return_inverse=True)
            row = np.repeat(np.arange(len(rows)), size)
            vs = m.v[places]
            c = np.concatenate((np.zeros((1, factors)), np.cumsum(vs, axis=0, dtype=np.float64)))
            sums = (c[here[1:]] - c[here[:-1]])[row]
            e = err[row]
            dw = np.bincount(where, e, len(used)) + decay * m.w[used]
            dv = np.stack([np.bincount(where, e * (sums[:, f] - vs[:, f]), len(used)) for f in range(factors)], axis=1) + decay * m.v[used]
            d0 = err.sum()
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += d0**2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def fit(found: list[np.ndarray], labels: np.ndarray, least: int = 2, away: float = 4.0, apart: float = 6.0, common: float = 0.01, factors: int = 4, steps: int = 2500, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 7) -> Machine:
    """Fit on the term hashes and 0/1 labels of a sample.

    The dictionary holds terms of at least ``least`` texts that say something,
    alone or with a partner; the others carry noise that a long text adds up.
    Alone: the share of toxic texts lies ``away`` standard errors from that of all.
    With a partner: a machine of those terms is fitted first, and where the texts
    that hold two terms are ``apart`` standard errors off what it expects of them,
    both terms join the dictionary of the final machine, however little either
    says alone. Pairs are looked for among all terms that at least ``common`` of
    the texts hold.
    """
    flat = np.concatenate([*found, np.zeros(0, np.uint64)])
    terms, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3))
    toxic = np.bincount(where, np.repeat(labels, [len(f) for f in found]), len(terms)) if len(flat) else np.zeros(0)
    del flat, where
    alone = (count >= least) & (np.abs(_alone(count, toxic, share)) >= away)

    def machine(chosen: np.ndarray) -> Machine:
        t = terms[chosen]
        m = Machine(t, float(np.log(share / (1 - share))), np.zeros(len(t), np.float32), rng.normal(0, 0.1, (len(t), factors)).astype(np.float32) / np.float32(max(1, len(t)) ** 0.25))
        return _fitted(m, found, labels, steps, rate, decay, batch, rng) if len(t) else m

    first = machine(alone)
    often = np.flatnonzero((count >= max(least, common * len(labels))))
    if len(often) < 2:
        return first
    expected = first.score(*first.rows(found))
    at, off = Machine(terms[often], 0.0, first.w, first.v).rows(found)
    joint = np.zeros(len(terms), dtype=bool)
    joint[often[_together(at, off, len(often), labels - expected, expected * (1 - expected), apart, least)]] = True
    return machine(alone | joint) if (joint & ~alone).any() else first


def trained(docs: DataFrame, labels: DataFrame, sample: int = 8000, **settings) -> Machine:
    """Fit on at most ``sample`` labelled doc_ids, those of least hash; null texts and labels are left out.

    ``labels`` has doc_id and toxic; of a doc_id with several labels the largest
    counts, of one with several texts the text of least hash, whatever its length.
    Terms are brought together by their hash before the driver sees them, and only
    those of enough texts go there, as numbers of texts: a term of a single text
    can't enter the dictionary. So the driver holds the sample's repeated terms, not
    its texts. Texts without such terms, and an empty table, add nothing.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.col("toxic").cast("int").alias("toxic")).collect()
    labels_of = np.array([r.toxic for r in rows], dtype=float)
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, i) for i, r in enumerate(rows)], f"doc_id {kind}, text_no int"))  # of bounded size
    texts = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("text_no", F.xxhash64("text").alias("fp"), "text")
    one = texts.groupBy("text_no").agg(F.min("fp").alias("fp"))
    texts = texts.join(F.broadcast(one), ["text_no", "fp"]).select("text_no", "text")

    def run(batches):
        for batch in batches:
            found = list(hashed_terms(batch.column(1)))
            off = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], names=["text_no", "terms"])

    each = texts.mapInArrow(run, "text_no int, terms array<bigint>").select("text_no", F.explode("terms").alias("term"))
    holders = each.groupBy("term").agg(F.array_sort(F.collect_set("text_no")).alias("held")).where(F.size("held") >= settings.get("least", 2)).toArrow()
    held = holders.column("held").combine_chunks()
    term = np.repeat(holders.column("term").to_numpy().view(np.uint64), held.value_lengths().to_numpy()) if len(holders) else np.zeros(0, np.uint64)
    text = held.flatten().to_numpy() if len(holders) else np.zeros(0, np.int64)
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    numbers, first = np.unique(text, return_index=True)
    return fit(np.split(term, first[1:]) if len(numbers) else [], labels_of[numbers], **settings)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row of ``docs``.

    A null or blank text has no term: its score is the machine's bias alone. Rows
    repeat as those of ``docs``; an empty table gives an empty one. The machine is
    broadcast; its size is bounded by the terms of the sample that it was fitted on.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        m = sent.value
        for batch in batches:
            scores = []
            found = []
            for x in hashed_terms(batch.column(1)):
                found.append(x)
                if len(found) == 256:
                    scores.append(m.score(*m.rows(found)))
                    found = []
            if found:
                scores.append(m.score(*m.rows(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
