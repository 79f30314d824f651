"""Language spans: scripts narrow the candidates, Viterbi over word scores labels the words.

A word is a run of letters. Its score for a language is the sum of the log
probabilities of its letters' trigrams (the letter and its neighbours, hashed to
2**16 buckets). Only languages that were seen with the word's script take part:
texts with words of the same scripts are worked on together, and the states of
their paths are the languages of these scripts and no others. The best path over
a text's words pays ``penalty`` for each switch of language; neighbouring words of
one language make a span.

The path is found in blocks of BLOCK words at once: the best way through each
block from every entry to every exit state, then the blocks of a text in order,
then the way inside each block from its known entry. The result is that of the
plain recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.textscan import mix64

BITS, BLOCK, SLICE_CHARS = 16, 128, 1_000_000
#: Letters scored together, and entry and exit states of blocks worked on together.
LETTERS, CELLS = 500_000, 1_000_000
#: First and last code point of the scripts' letters.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
_OTHER = 1
_table: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Of each code point 0 (no letter), 1 (a letter of another script) or 2 and on by the order of SCRIPTS."""
    if not _table:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        out = letter.astype(np.uint8) * _OTHER
        for i, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                out[a : b + 1][letter[a : b + 1]] = i + 2
        _table.append(out)
    return _table[0]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """Words of a slice of texts."""

    bucket: np.ndarray  # of each letter
    letter: np.ndarray  # its place in the slice
    first: np.ndarray  # of each word its first letter (and the number of letters)
    script: np.ndarray  # of each word
    start: np.ndarray
    end: np.ndarray
    text_off: np.ndarray  # of each text its first word (and the number of words)
    off: np.ndarray  # of each text its first character


def slices(texts: list[str | None]) -> Iterator[tuple[int, int, Words]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE_CHARS):
            size += len(texts[j] or "")
            j += 1
        part = [_lower(t or "") for t in texts[i:j]]
        off = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        code = np.frombuffer("\n".join([*part, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        script = script_table()[code]
        is_letter = script > 0
        plain = np.where(is_letter, code, 32).astype(np.uint64)
        letter = np.flatnonzero(is_letter)
        before, after = plain[np.maximum(letter - 1, 0)], plain[np.minimum(letter + 1, len(plain) - 1)]
        before[letter == 0] = 32
        bucket = (mix64((before << np.uint64(42)) | (plain[letter] << np.uint64(21)) | after) >> np.uint64(64 - BITS)).astype(np.int32)
        gap = np.concatenate(([True], np.diff(letter) > 1)) if len(letter) else np.zeros(0, bool)
        first = np.flatnonzero(gap)
        start = letter[first]
        end = np.concatenate((letter[first[1:] - 1], letter[-1:])) + 1
        yield i, j, Words(bucket, letter, np.append(first, len(letter)), script[start], start, end, np.searchsorted(start, off), off)
        i = j


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # bucket, language
    allowed: np.ndarray  # script, language

    def scores(self, w: Words, words: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Of some words for some languages; languages of other scripts get a score no path would take."""
        out = np.zeros((len(words), len(langs)))
        size = np.diff(w.first)[words]
        ends = np.concatenate(([0], np.cumsum(size)))
        logp = self.logp[:, langs]
        i = 0
        while i < len(words):  # about LETTERS letters at a time
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + LETTERS, side="right")) - 1)
            place = np.repeat(w.first[words[i:j]] - (ends[i:j] - ends[i]), size[i:j]) + np.arange(ends[j] - ends[i])
            out[i:j] = np.add.reduceat(logp[w.bucket[place]], ends[i:j] - ends[i], axis=0, dtype=np.float64)
            i = j
        ok = self.allowed[w.script[words]][:, langs]
        known = ok.any(axis=1)
        out[~ok & known[:, None]] -= 1e4
        out[~known] = 0
        return out

    def path(self, w: Words, penalty: float) -> np.ndarray:
        """The best language of each word."""
        count = np.diff(w.text_off)
        text = np.repeat(np.arange(len(count)), count)
        seen = np.zeros((len(count), self.allowed.shape[0]), dtype=bool)
        seen[text, w.script] = True
        kinds, kind = np.unique(seen, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        out = np.zeros(len(text), dtype=np.int64)
        for k, scripts in enumerate(kinds):
            words = np.flatnonzero(kind[text] == k)
            langs = np.flatnonzero(self.allowed[scripts].any(axis=0))
            if len(words) and not len(langs):  # no language was seen with these scripts
                langs = np.arange(len(self.langs))
            if len(words):
                off = np.concatenate(([0], np.cumsum(count[kind == k])))
                out[words] = langs[paths(self.scores(w, words, langs), off, penalty)]
        return out


def paths(scores: np.ndarray, text_off: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, by text."""
    n, m = scores.shape
    count = np.diff(text_off)
    blocks = -(-count // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    total = int(first_block[-1])
    state = np.zeros(n, dtype=np.int64)
    if not total:
        return state
    text = np.repeat(np.arange(len(count)), count)
    within = np.arange(n) - text_off[text]
    block, place = first_block[text] + within // BLOCK, within % BLOCK
    padded = np.zeros((BLOCK, total, m))
    padded[place, block] = scores
    way = np.full((total, m, m), -np.inf)
    way[:, np.arange(m), np.arange(m)] = 0
    some = max(1, CELLS // (m * m))
    for i in range(0, total, some):  # few enough blocks at a time for the working arrays
        part = way[i : i + some]
        for t in range(BLOCK):
            part = np.maximum(part, part.max(axis=2, keepdims=True) - penalty) + padded[t, i : i + some][:, None, :]
        way[i : i + some] = part
    # the blocks of each text in order
    value, entry = np.zeros((len(count), m)), np.zeros((total, m), dtype=np.int64)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        b = first_block[on] + k
        through = value[on][:, :, None] + way[b]
        entry[b], value[on] = through.argmax(axis=1), through.max(axis=1)
    goal, came = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    now = value.argmax(axis=1)
    for k in range(int(blocks.max()) - 1, -1, -1):
        on = np.flatnonzero(blocks > k)
        b = first_block[on] + k
        goal[b] = now[on]
        now[on] = came[b] = entry[b, now[on]]
    # inside each block from its entry
    rows = np.arange(total)
    best = np.full((total, m), -np.inf)
    best[rows, came] = 0
    back = np.zeros((BLOCK, total, m), dtype=np.uint8 if m < 256 else np.int32)
    for t in range(BLOCK):
        switch = best.max(axis=1, keepdims=True) - penalty
        stay = best >= switch
        back[t] = np.where(stay, np.arange(m), best.argmax(axis=1)[:, None])
        best = np.where(stay, best, switch) + padded[t]
    which, here = np.zeros((BLOCK, total), dtype=np.int64), goal
    for t in range(BLOCK - 1, -1, -1):
        which[t] = here
        here = back[t, rows, here].astype(np.int64)
    return which[place, block]


def counted(docs: DataFrame) -> DataFrame:
    """(text, lang) -> (lang, bucket, n): trigram buckets, and scripts as buckets from 2**16 on, over all rows."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                for _, _, w in slices([t for t, x in zip(texts, langs) if x == lang]):
                    both = np.concatenate((np.bincount(w.bucket, minlength=1 << BITS), np.bincount(w.script, np.diff(w.first), len(SCRIPTS) + 2).astype(np.int64)))
                    total[lang] = total.get(lang, 0) + both
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame) -> Model:
    """The model of all rows with text and lang. It has 2**16 numbers a language, whatever the input."""
    rows = counted(docs).toArrow()
    lang, bucket, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    langs = sorted(set(lang.tolist()))
    count = np.zeros(((1 << BITS) + len(SCRIPTS) + 2, len(langs)))
    count[bucket, np.searchsorted(np.array(langs, dtype=object), lang) if len(langs) else []] = n
    grams, scripts = count[: 1 << BITS], count[1 << BITS :]
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * (1 << BITS)))
    return Model(langs, logp.astype(np.float32), scripts >= 0.01 * np.maximum(scripts.sum(axis=0), 1))


def labelled(docs: DataFrame, model: Model, penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans, if asked for) of each row of ``docs`` (doc_id, text).

    lang_pred is the language of most letters, the first in order of name on a
    tie; score is its share of the letters. A null text, a text without letters,
    or a model without languages gives ``und`` and 0. Spans are (start, end, lang)
    in code points. Rows repeat as those of ``docs``; an empty table gives an empty
    one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            lang, score, marks = [], [], []
            for i, j, w in slices(batch.column(1).to_pylist()):
                if not m.langs or not len(w.start):
                    lang += ["und"] * (j - i)
                    score += [0.0] * (j - i)
                    marks += [[]] * (j - i)
                    continue
                path = m.path(w, penalty)
                size = np.diff(w.first)
                text = np.repeat(np.arange(j - i), np.diff(w.text_off))
                letters = np.bincount(text * len(m.langs) + path, size, (j - i) * len(m.langs)).reshape(j - i, -1)
                best, all_ = letters.argmax(axis=1), letters.sum(axis=1)
                lang += [m.langs[b] if a else "und" for a, b in zip(all_, best)]
                score += (letters.max(axis=1) / np.maximum(all_, 1)).tolist()
                if spans:
                    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (path[1:] != path[:-1]))))
                    last = np.append(new[1:], len(path)) - 1
                    own: list[list] = [[] for _ in range(j - i)]
                    for a, b in zip(new.tolist(), last.tolist()):
                        own[text[a]].append({"start": int(w.start[a] - w.off[text[a]]), "end": int(w.end[b] - w.off[text[a]]), "lang": m.langs[path[a]]})
                    marks += own
            out = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            if spans:
                out.append(pa.array(marks, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else ""))
