"""Byte-level BPE by content-defined chunks that documents share.

A rolling hash over the last 32 bytes cuts each text where its low bits are all
zero, so equal passages are cut alike wherever they stand. Documents go to tasks
by their least chunk hash, which near copies mostly share, and a task encodes a
chunk once however many of its documents hold it.

Encoding chunks apart is wrong near their joins. A join is repaired from the
last place before it to the first place after it where any encoding must break:
the end of a run of letters or of digits, or the start of a run of white space.
The window between is encoded again and replaces what both chunks had there. It
first reaches one such place further on each side: if what was re-encoded there
does not agree with the chunks' own ids, the window is widened until it does.
A cut that would leave a chunk without such a place is not made, so that a join
never reaches further back than the chunk before it.
"""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.textscan import mix64, powers

#: Bytes that the rolling hash sees, and the mask that makes a cut: about one in 2048 bytes, 256 bytes apart at least.
SEEN, MASK, LEAST = 32, np.uint64(2047), 256
#: Bytes of ids that a task keeps for reuse; the chunks used longest ago go first.
CACHE_BYTES = 48_000_000
_SAFE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=[ \t\r\n])"


@lru_cache(maxsize=2)
def special_tokens(path: str) -> tuple[bytes, ...]:
    """Strings of the added tokens of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        return tuple(x["content"].encode() for x in json.load(f)["added_tokens"])


@lru_cache(maxsize=2)
def _places(special: tuple[bytes, ...]) -> regex.Pattern:
    """Matches are empty where any encoding breaks; a special token is matched as a whole."""
    return regex.compile("|".join([*(regex.escape(x.decode()) for x in special), _SAFE]))


@lru_cache(maxsize=2)
def codec(path: str):
    """Encoder, bytes of each id, and their lengths, from a tokenizers file with byte-level BPE."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte that each character of the file stands for
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    raw = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    from public_tokenizers import PATTERN

    size = max([*raw.values(), *added.values()]) + 1
    table = [b""] * size
    for token, i in raw.items():
        table[i] = token
    for text, i in added.items():
        table[i] = text.encode()
    # ranks of merges are ids here: the file lists tokens in merge order
    ranks = {k: v for k, v in raw.items() if k.decode("latin-1") not in added}
    coder = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return (lambda text: coder.encode(text, allowed_special="all")), table, np.array([len(t) for t in table], dtype=np.int64)


def cuts(data: bytes, special: tuple[bytes, ...] = ()) -> list[int]:
    """Ends of the chunks of a text in UTF-8; no cut falls inside a character or a special token."""
    n = len(data)
    if n <= max(LEAST, SEEN):
        return [n]
    buf = np.frombuffer(data, dtype=np.uint8)
    up, down = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    roll = mix64((sums[SEEN:] - sums[:-SEEN]) * down[: n + 1 - SEEN])
    out, last, tried = [], 0, 0
    for c in (np.flatnonzero((roll & MASK) == 0) + SEEN).tolist():
        if c - last < LEAST or n - c < LEAST or data[c] & 0xC0 == 0x80 or any(x in data[max(0, c - len(x) + 1) : c + len(x) - 1] for x in special):
            continue
        if _breaks(data, max(last, tried), c, last, special, first=True):
            out.append(c)
            last = c
        else:
            tried = c  # no place up to here; only a special token may lie across
    return [*out, n]


def _breaks(data: bytes, low: int, high: int, edge: int, special: tuple[bytes, ...], first: bool = False) -> list[int]:
    """Bytes inside (low, high) where any encoding breaks; ``low`` may fall inside a character or, down to ``edge``, a special token."""
    start = max(edge, low - max(map(len, special), default=0) - 4)
    while start > edge and data[start] & 0xC0 == 0x80:
        start -= 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    text = data[start:high].decode()
    ascii_, out, last, at = text.isascii(), [], 0, start
    for m in _places(special).finditer(text):
        if m.start() < m.end():
            continue
        at += m.start() - last if ascii_ else len(text[last : m.start()].encode())
        last = m.start()
        if at > low:
            out.append(at)
            if first:
                break
    return out


class Chunks:
    """Encodes chunks of one task, each once while it is kept."""

    def __init__(self, path: str) -> None:
        self.encode, self.table, self.size = codec(path)
        self.special = special_tokens(path)
        self.kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.bytes = self.made = self.used = 0

    def ids(self, chunk: bytes) -> np.ndarray:
        self.used += 1
        key = hashlib.blake2b(chunk, digest_size=16).digest()
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        self.made += 1
        out = np.array(self.encode(chunk.decode()), dtype=np.uint32)
        self.kept[key] = out
        self.bytes += out.nbytes + 100
        while self.bytes > CACHE_BYTES:
            self.bytes -= self.kept.popitem(last=False)[1].nbytes + 100
        return out

    def text(self, data: bytes) -> np.ndarray:
        """Ids of a whole text, joins repaired."""
        ends = cuts(data, self.special)
        if len(ends) == 1:
            return self.ids(data)
        done, base = self.ids(data[: ends[0]]), 0  # what no later join can change any more goes to parts
        parts: list[np.ndarray] = []
        for a, b in zip(ends, ends[1:]):
            settled, done, base = self._joined(data, done, base, self.ids(data[a:b]), a, b)
            parts.append(settled)
        return np.concatenate([*parts, done])

    def _joined(self, data: bytes, left: np.ndarray, base: int, right: np.ndarray, at: int, end: int):
        """Repair the join at byte ``at`` between ``left`` (from byte ``base``) and ``right`` (to ``end``).

        Gives the settled ids, those still open, and the first byte of the latter,
        which is a place where any encoding breaks. A right chunk without such a
        place stays open together with the left one.
        """
        lpos = base + np.concatenate(([0], np.cumsum(self.size[left])))
        rpos = at + np.concatenate(([0], np.cumsum(self.size[right])))
        reach = 64
        while True:
            low, high = max(base, at - reach), min(end, at + reach)
            lefts, rights = _breaks(data, low, at, base, self.special), _breaks(data, at, high, at, self.special)
            whole_left, whole_right = low == base, high == end
            if (len(lefts) >= 2 or whole_left) and (len(rights) >= 2 or whole_right):
                lo = lefts[-2] if len(lefts) >= 2 else base
                hi = rights[1] if len(rights) >= 2 else rights[0] if rights else end
                window = np.array(self.encode(data[lo:hi].decode()), dtype=np.uint32)
                i, j = np.searchsorted(lpos, lo), np.searchsorted(rpos, hi)
                exact = lpos[i] == lo and rpos[j] == hi
                wpos = lo + np.concatenate(([0], np.cumsum(self.size[window])))
                if exact and len(lefts) >= 2:  # what lies before the last place must agree
                    k, w = np.searchsorted(lpos, lefts[-1]), np.searchsorted(wpos, lefts[-1])
                    exact = lpos[k] == lefts[-1] and wpos[w] == lefts[-1] and np.array_equal(left[i:k], window[:w])
                if exact and len(rights) >= 2:
                    k, w = np.searchsorted(rpos, rights[0]), np.searchsorted(wpos, rights[0])
                    exact = rpos[k] == rights[0] and wpos[w] == rights[0] and np.array_equal(right[k:j], window[w:])
                if exact or (whole_left and whole_right):
                    joined = np.concatenate((left[:i], window))
                    if rights:
                        return joined, right[j:], int(hi)
                    return joined[:0], joined, base
            reach *= 2


def _least_chunk(data: bytes, special: tuple[bytes, ...]) -> int:
    at, least = 0, None
    for end in cuts(data, special):
        h = int.from_bytes(hashlib.blake2b(data[at:end], digest_size=8).digest(), "little", signed=True)
        least = h if least is None or h < least else least
        at = end
    return least


def placed(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) dealt out so that documents with equal chunks mostly meet; large groups are split by size."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py().encode() if x.is_valid else b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_least_chunk(x, special_tokens(path)) for x in texts], pa.int64())], names=["doc_id", "text", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, place bigint").hint("rebalance", F.col("place"))


def encoded(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of each whole text.

    ``path`` names a tokenizers JSON file of a byte-level BPE; every executor needs
    it. A null or empty text has no id. Equal rows give equal results; an empty
    table gives an empty one. Ids are those of the tokenizers library without added
    special tokens; a special token's own string in a text has its id.
    """

    def run(batches):
        chunks = Chunks(path)
        table = chunks.table
        for batch in batches:
            rows = []
            for x in batch.column(1):
                data = x.as_py().encode() if x.is_valid else b""
                ids = chunks.text(data) if data else np.zeros(0, np.uint32)
                back = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").encode()
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), ids))
            out = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                out.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed(docs, path).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""))
