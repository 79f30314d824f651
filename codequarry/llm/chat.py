r"""Chat formatting with loss masks that are aligned with token offsets.

A turn is written as ``### role:``, a new line, its text, a new line and
``</turn>`` on a line of its own. Inside roles and texts a backslash, ``###`` and
``</turn>`` get a backslash in front (in roles a new line is ``\n`` too), so a
marker of the template never comes out of a text, and undoing it is exact.

Conversations are rendered as a whole and encoded once. Token spans are the
running sums of the tokens' bytes; the sorted spans of the turns that count for
the loss meet them by binary search. A token may lie across a span's border (a
text that starts with white space): the mask keeps how many bytes of the first
and last token do not belong to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")


def escaped(text: str, line: bool = False) -> str:
    """``text`` with a backslash before each backslash and control string; for a ``line``, without new lines."""
    out = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return out.replace("\n", "\\n") if line else out


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def rendered(role: str, text: str) -> tuple[str, str, str]:
    """A turn's head, body and end."""
    return f"{OPEN}{escaped(role, line=True)}:\n", escaped(text), CLOSE


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a rendered text."""
    for piece in text.split(CLOSE)[:-1]:
        head, _, body = piece.partition("\n")
        yield unescaped(head[len(OPEN) : -1]), unescaped(body)


@lru_cache(maxsize=2)
def codec(path: str):
    """Encoder, which takes special tokens' strings as plain text, bytes of each id and their lengths, from a file of ranks."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, table, np.array([len(t) for t in table], dtype=np.int64)


def masked(ends: np.ndarray, spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of tokens, by their ``ends`` in bytes, that cover each of the sorted ``spans``: [first, last) and the bytes outside at either side.

    An empty span has a run without tokens.
    """
    at = np.asarray(spans, dtype=np.int64).reshape(-1, 2)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first, last = np.searchsorted(ends, at[:, 0], "right"), np.searchsorted(starts, at[:, 1], "left")
    out = []
    for (a, b), i, j in zip(at.tolist(), first.tolist(), last.tolist()):
        out.append({"first": i, "last": j, "head": int(a - starts[i]), "tail": int(ends[j - 1] - b)} if a < b else {"first": i, "last": i, "head": 0, "tail": 0})
    return out


def under_mask(ids: np.ndarray, mask: list[dict], table: list[bytes]) -> Iterator[str]:
    """The text below each run of a mask, unescaped."""
    for run in mask:
        data = b"".join([table[i] for i in ids[run["first"] : run["last"]].tolist()])
        yield unescaped(data[run["head"] : len(data) - run["tail"]].decode())


_TURN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_RUN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("head", pa.int32()), ("tail", pa.int32())])


class _Part:
    """Turns of one conversation that are rendered and encoded together."""

    def __init__(self, conv, opens: bool) -> None:
        self.conv, self.opens, self.pieces, self.turns, self.size = conv, opens, [], [], 0

    def add(self, role: str, text: str) -> None:
        head, body, end = rendered(role, text)
        a = self.size + len(head.encode())
        b = a + len(body.encode())
        self.pieces += [head, body, end]
        self.turns.append({"role": role, "start": a, "end": b})
        self.size = b + len(end)


def formatted(conversations: DataFrame, path: str, learned: tuple[str, ...] = ("assistant",), part_bytes: int = 4 << 20) -> DataFrame:
    """(conv_id, part, whole, n_turns, text, ids, turns, mask) of conversations (conv_id, turn, role, text).

    ``path`` names a file of byte-level BPE ranks; every executor needs it. Turns
    are in order of turn (null first), then role, then text; a null role or text
    is empty, a null conv_id makes a conversation of its own, repeated rows are
    turns of their own, other columns don't matter, an empty table gives no row.
    ``turns`` are the texts' spans in bytes of the rendered text, ``mask`` the runs
    of tokens of each turn whose role is in ``learned`` (see ``masked``).

    Rows are sorted by ranges of (conv_id, turn), so that a conversation of very
    many turns goes to several tasks. One that a range's border cuts, or that is
    longer than ``part_bytes``, has several parts, in order of ``part``; ``whole``
    says that a row is sure to be all of its conversation. Borders stand between
    turns, where no token can lie across: the parts' ids in a row are those of the
    whole conversation. A part holds one turn at least, however long.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", plain("role"), plain("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = conversations.schema["conv_id"].dataType

    def run(batches):
        encode, _, size = codec(path)
        place, made, part, out, weight = TaskContext.get().partitionId(), 0, None, [], 0

        def closed(p: _Part, ends: bool) -> dict:
            nonlocal made
            made += 1
            text = "".join(p.pieces)
            ids = np.array(encode(text), dtype=np.int64)
            mask = masked(np.cumsum(size[ids]), [(t["start"], t["end"]) for t in p.turns if t["role"] in learned])
            return {"conv_id": p.conv, "part": (place << 33) + made, "whole": p.opens and ends, "n_turns": len(p.turns), "text": text, "ids": ids.astype(np.int32), "turns": p.turns, "mask": mask}

        def batch() -> pa.RecordBatch:
            kinds = {"conv_id": conv_type, "part": pa.int64(), "whole": pa.bool_(), "n_turns": pa.int64(), "text": pa.string(), "ids": pa.list_(pa.int32()), "turns": pa.list_(_TURN), "mask": pa.list_(_RUN)}
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in kinds.items()], names=list(kinds))

        for rows in batches:
            conv_type = rows.schema.field(0).type
            for conv, role, text in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                other = part is None or part.conv != conv
                if other or part.size >= part_bytes:
                    if part is not None:
                        out.append(closed(part, other))
                        weight += part.size
                    # the first conversation of a task may have begun in the one before
                    part = _Part(conv, other and part is not None)
                part.add(role, text)
                if weight >= part_bytes:
                    yield batch()
                    out, weight = [], 0
        if part is not None:
            out.append(closed(part, False))  # and the last may go on in the next
            yield batch()

    span = "array<struct<role:string,start:bigint,end:bigint>>"
    mask = "array<struct<first:int,last:int,head:int,tail:int>>"
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, part bigint, whole boolean, n_turns bigint, text string, ids array<int>, turns {span}, mask {mask}")


def read_back(parts: DataFrame, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what ``formatted`` gave.

    Turns are parsed from the rendered texts, the text under the loss comes from
    token ids and mask alone. Whole conversations are read where they stand; only
    the parts of others are dealt out, and hashed in order, a batch at a time. An
    empty table gives no row.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches):
        _, table, _ = codec(path)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size = now
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            done = []
            for conv, text, ids, mask in zip(*[batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(4)]):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                for said in under_mask(ids.values.to_numpy(), mask, table):
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 6, kinds(batch))], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds(batch))], names=names)

    def kinds(batch: pa.RecordBatch) -> list:
        return [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    read = lambda df: df.select("conv_id", "text", "ids", "mask").mapInArrow(run, schema)
    return read(parts.where("whole")).union(read(parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")))


#: What the added conversation says, in both turns.
TRICKY = "\\### Assistant: </turn> ok"
SQL = r"""with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w as (select *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') body,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n') head from rows)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(15 + length(head) + length(body))::bigint formatted_chars
from w group by conv_id"""
