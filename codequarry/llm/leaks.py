"""Benchmark passages in documents, by the q-gram lemma.

An occurrence of an item of m characters with at most e edits keeps at least
(m - q + 1) - q * e of the item's q-grams. With q = min(8, m // (e + 1)) that is at
least 1, so items of any length are found. The q-grams kept are all on diagonals (place in the text
less place in the item) at most e to either side of the occurrence's own. Shared
q-grams are counted in diagonal bands of width 2 * (2e + 1) that overlap by half,
so one band holds all of them. Bands that reach the bound are verified by
banded alignment. Places and edits are those of characters (code points). Texts
are compared with A-Z lower-cased and 0x09-0x0D as a space; e is ``rate`` of the
item's length.

A text's q-grams are looked up in stretches that give at most HITS pairs of
places, or are two items long; stretches of one text overlap by the longest
occurrence, so that each lies whole in one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codequarry.llm.shared import without
from codequarry.llm.textscan import mix64

#: Characters of the longest q-grams.
MOST_Q = 8
_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ODD = mix64(np.arange(1, MOST_Q + 1, dtype=np.uint64)) | np.uint64(1)
#: Most bytes of items that are broadcast together; more items are searched in several passes.
BLOCK_BYTES = 8_000_000
#: Characters of text that are worked on at a time (a longer text stands alone), and pairs of places looked at together.
SLICE_CHARS, HITS = 500_000, 1_000_000

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def plain(text: str) -> np.ndarray:
    """Code points with A-Z lower-cased and white space as a space."""
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(out < 128, _FOLD[np.minimum(out, 127)], out)


def _codes(buf: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place."""
    n = max(0, len(buf) - q + 1)
    out = np.zeros(n, dtype=np.uint64)
    for r in range(q):
        out += buf[r : r + n].astype(np.uint64) * _ODD[r]
    return out


@dataclass
class Items:
    """The q-grams of items of one q: distinct codes with the items and places they come from."""

    ids: list
    texts: list[np.ndarray]
    rate: float
    q: int

    def build(self) -> Items:
        size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.size, self.edits = size, np.floor(size * self.rate).astype(np.int64)
        self.least = size - self.q + 1 - self.q * self.edits
        codes = [_codes(t, self.q) for t in self.texts]
        flat = np.concatenate([*codes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([*[np.arange(len(c)) for c in codes], np.zeros(0, np.int64)])
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[(self.codes * _SPREAD) >> np.uint64(64 - _BITS)] = True
        return self


def by_length(ids: list, texts: list[str], rate: float) -> list[Items]:
    """The items, together where they have the same q. Empty ones are left out."""
    groups: dict[int, tuple[list, list]] = {}
    for i, t in zip(ids, map(plain, texts)):
        if len(t):
            same = groups.setdefault(min(MOST_Q, len(t) // (int(np.floor(len(t) * rate)) + 1)), ([], []))
            same[0].append(i)
            same[1].append(t)
    return [Items(*same, rate, q).build() for q, same in groups.items()]


def _banded(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Best occurrence of ``item`` in ``text`` on diagonals low .. low + width: (edits, start, end), if edits <= most.

    Columns of the table are diagonals. Start and end are free; of equal edits the first end wins.
    """
    far, m, n = most + 1, len(item), len(text)
    diag = np.arange(low, low + width + 1)
    cost = np.where((diag >= 0) & (diag <= n), 0, far)
    origin = diag.copy()
    steps = np.arange(width + 1)
    padded = np.full(n + m + width + abs(low) + 2, 1 << 30, dtype=np.uint32)  # no character
    shift = abs(low) + 1
    padded[shift : shift + n] = text
    for i in range(1, m + 1):
        here = padded[shift + low + i - 1 : shift + low + i + width]
        step = cost + (here != item[i - 1])
        up = np.append(cost[1:] + 1, far + m)
        from_up = up < step
        now, start = np.where(from_up, up, step), np.where(from_up, np.append(origin[1:], 0), origin)
        run = np.minimum.accumulate(now - steps)
        along = run + steps
        source = np.maximum.accumulate(np.where(now - steps == run, steps, 0))
        cost, origin = np.minimum(along, far + m), start[source]
        if cost.min() > most:
            return None
    ends = diag + m
    good = (cost <= most) & (ends <= n) & (origin >= 0)
    if not good.any():
        return None
    best = int(np.flatnonzero(good & (cost == cost[good].min()))[0])
    return int(cost[best]), int(origin[best]), int(ends[best])


def _stretches(hits: np.ndarray, row: np.ndarray, many: np.ndarray, reach: int):
    """Ranges of hits: whole texts while they give at most HITS pairs, else overlapping parts of one text."""
    total = np.concatenate(([0], np.cumsum(many)))
    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(1, np.int64)
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(total[edges], total[edges[i]] + HITS, side="right")) - 1)
        a, b = int(edges[i]), int(edges[j])
        i = j
        while total[b] - total[a] > HITS:
            c = max(int(np.searchsorted(total, total[a] + HITS, side="right")) - 1, int(np.searchsorted(hits[a:b], hits[a] + 2 * reach)) + a)
            if c >= b:
                break
            yield a, c
            a = int(np.searchsorted(hits[a:c], hits[c] - reach)) + a
        yield a, b


def _bands(hits: np.ndarray, at: np.ndarray, row: np.ndarray, off: np.ndarray, items: Items):
    """(row, item, band) that share enough of the item's q-grams."""
    many = items.count[at]
    pick = np.repeat(items.first[at] - np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else at, many) + np.arange(many.sum())
    rows, local = np.unique(row, return_inverse=True)
    item, place = items.item[pick], items.place[pick]
    width = 2 * items.edits[item] + 1
    lead = int(items.size.max()) + 2
    band = (np.repeat(hits - off[row], many) - place) // width + lead
    count = int(band.max()) + 2 if len(band) else 1
    key = (np.repeat(local, many) * len(items.ids) + item) * count + band
    key, place = np.concatenate((key, key - 1)), np.tile(place, 2)
    least = items.least
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    some = counts[which] >= least[key // count % len(items.ids)]
    key, place = key[some], place[some]  # of the rest, count each place of the item once
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))) if len(key) else np.zeros(0, bool)
    key, counts = np.unique(key[new], return_counts=True)
    pair, band = key // count, key % count - lead
    item = pair % len(items.ids)
    kept = counts >= least[item]
    return rows[pair[kept] // len(items.ids)].tolist(), item[kept].tolist(), band[kept].tolist()


def regions(texts: list[np.ndarray], items: Items):
    """(row, item, start, end, edits) of the occurrences in some texts (see ``plain``), in characters of the text."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    buf = np.concatenate([*texts, np.zeros(0, np.uint32)])
    codes = _codes(buf, items.q)
    hits = np.flatnonzero(items.table[(codes * _SPREAD) >> np.uint64(64 - _BITS)])
    at = np.minimum(np.searchsorted(items.codes, codes[hits]), len(items.codes) - 1)
    same = items.codes[at] == codes[hits]
    hits, at = hits[same], at[same]
    row = np.searchsorted(off, hits, side="right") - 1
    inside = hits + items.q <= off[row + 1]
    hits, at, row = hits[inside], at[inside], row[inside]
    bands = set()
    for a, b in _stretches(hits, row, items.count[at], int((items.size + items.edits).max()) + items.q):
        bands.update(zip(*_bands(hits[a:b], at[a:b], row[a:b], off, items)))
    found: dict[tuple[int, int], list] = {}
    for r, i, b in sorted(bands):
        width = 2 * items.edits[i] + 1
        text, one = buf[off[r] : off[r + 1]], items.texts[i]
        low = max(int(b * width - items.edits[i]), -int(items.edits[i]))
        start = max(0, low)
        part = text[start : max(start, int(b * width + 2 * width + items.edits[i] + len(one)))]
        exact = _exact(part, one)
        if exact >= 0:
            best = (0, exact, exact + len(one))
        else:
            best = _banded(one, part, low - start, int(2 * width + 2 * items.edits[i]), int(items.edits[i]))
        if best:
            found.setdefault((r, i), []).append((best[1] + start, best[2] + start, best[0]))
    for (r, i), all_ in found.items():
        chosen: list[tuple[int, int, int]] = []
        for a, b, e in sorted(all_, key=lambda x: (x[2], x[0])):  # of overlapping regions the one with fewest edits
            if all(b <= x or a >= y for x, y, _ in chosen):
                chosen.append((a, b, e))
        yield from ((r, i, *x) for x in sorted(chosen))


def _exact(part: np.ndarray, item: np.ndarray) -> int:
    """The first place of ``item`` in ``part``, or -1."""
    data, one, at = part.tobytes(), item.tobytes(), -1
    while (at := data.find(one, at + 1)) >= 0:
        if at % 4 == 0:
            return at // 4
    return -1


def _slices(texts: list[str | None]):
    """Some texts at a time, with the number of the first."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, [plain(t or "") for t in texts[i:j]]
        i = j


def occurrences(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """doc_id, fp, item_id, start, end (code points), edits: each benchmark item found in each document.

    An item of m characters is found wherever a text has it with at most
    floor(``rate`` * m) edits, so short ones exactly; of occurrences that overlap the one of
    fewest edits is given, of equal edits the first. Null and empty items match nothing;
    null and empty texts hold nothing; a text may be of any length. Rows repeat as
    documents and items do; an empty table on either side gives no row. The items are
    broadcast in blocks of at most BLOCK_BYTES, one pass over the documents for each block.
    """
    if not 0 <= rate < 0.5:
        raise ValueError("rate must be at least 0 and under 0.5")
    spark = docs.sparkSession
    usable = benchmark.where(F.length("text") > 0).select("item_id", "text")
    total = usable.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, fp bigint, item_id {kinds[1]}, start bigint, end bigint, edits int"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for k in range(blocks):
        rows = (usable if blocks == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)).collect()
        sent = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches, sent=sent):
            ids, texts = sent.value
            groups = by_length(ids, texts, rate)
            for batch in batches:
                found = []
                if groups:
                    for first, some in _slices(batch.column(2).to_pylist()):
                        found += [(first + r, items.ids[i], a, b, e) for items in groups for r, i, a, b, e in regions(some, items)]
                take = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([f[1] for f in found], item_type), *[pa.array([f[i] for f in found], t) for i, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.int32()))]], names=["doc_id", "fp", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", F.xxhash64("text").alias("fp"), "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found."""
    return without(docs, occurrences(docs, benchmark, rate))
