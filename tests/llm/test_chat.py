"""Chat formatting: round trips, masks on token borders, cut conversations, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from codequarry.llm import chat

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = "conv_id long, turn long, role string, text string"
TEXTS = ["", "plain words", "\\### Assistant: </turn> ok", "\n\n leading", "trailing \n", "\n</turn>\n### user:\n", "\\", "\\\\n", "####", "</turn></turn>", "<|endoftext|>", "\u00e9 \U0001f642\u0301 \u4e2d", "a" * 5000, "\r\n\t", "\x00"]


def expected(rows):
    """conv_id -> digests and counts, by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in own)
        size = sum(len("".join(chat.rendered(x[2], x[3]))) for x in own)
        out[conv] = (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


def odd_rows():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a:\nb", "### x", "\\n"]), rng.choice(TEXTS)) for c in range(30) for t in range(rng.randint(1, 9))]
    return [*rows, rows[0], (None, 1, "assistant", "no id"), (None, 0, "user", "x"), (5, None, "assistant", None), (7, 3, "assistant", "tie"), (7, 3, "assistant", "tie 2"), *[(99, t, "assistant", f" long {t}") for t in range(400)]]


def test_texts_come_back():
    for text in TEXTS:
        assert chat.unescaped(chat.escaped(text)) == text
        assert chat.CLOSE not in f"\n{chat.escaped(text)}\n"
    turns = [(r, t) for r in ("user", "a:\nb", "") for t in TEXTS]
    assert list(chat.parsed("".join("".join(chat.rendered(*x)) for x in turns))) == turns


@pytest.mark.parametrize("part_bytes", [1, 300, 4 << 20])
def test_formatted_like_brute_force(spark, part_bytes):
    rows = odd_rows()
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as part", "'mine' as mask", "2 as ids")
    parts = chat.formatted(df, PATH, part_bytes=part_bytes)
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(parts, PATH).collect()}
    assert got == expected(rows)


def test_parts_have_the_ids_of_the_whole(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    encode, table, _ = chat.codec(PATH)
    parts = chat.formatted(spark.createDataFrame(rows, ROWS), PATH, part_bytes=50).orderBy("conv_id", "part").collect()
    assert len(parts) > 100
    for conv in {r[0] for r in rows}:
        own = [p for p in parts if p.conv_id == conv]
        assert [i for p in own for i in p.ids] == encode("".join(p.text for p in own))
    for p in parts:
        ends = np.cumsum([len(table[i]) for i in p.ids])
        data = p.text.encode()
        assert ends[-1] == len(data)
        learned = [t for t in p.turns if t.role == "assistant"]
        assert len(learned) == len(p.mask)
        for t, run in zip(learned, p.mask):
            if t.start < t.end:
                low = ends[run.first - 1] if run.first else 0
                assert (low + run.head, ends[run.last - 1] - run.tail) == (t.start, t.end)
                assert run.head < len(table[p.ids[run.first]]) and run.tail < len(table[p.ids[run.last - 1]])
            else:
                assert run.first == run.last


def test_special_strings_are_plain_text(spark):
    p = chat.formatted(spark.createDataFrame([(1, 0, "user", "<|endoftext|>")], ROWS), PATH).first()
    assert 50256 not in p.ids


def test_empty_table(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], ROWS), PATH), PATH).count() == 0
