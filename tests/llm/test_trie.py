"""The prefix trie: brute force over blocks of any size, rebuilt conversations, odd rows, hot members."""

import hashlib
import random
import zlib

import pytest

from codequarry.llm import trie

ROWS = "conv_id long, turn long, role string, text string"


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:3], digest(*x[2:])))] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + own[c][h:]
    return out


def brute_nodes(seqs):
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = lambda q: [x for x in members if len(x) == len(q) + 1 and x[: len(q)] == q]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids(p)), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_rows(rng, convs, words, longest):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in convs for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed,block", [(1, 2), (2, 3), (3, 7), (4, 16_384)])
def test_nodes_like_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = random_rows(rng, range(-120, 120, 3), ["a", "bb", ""][: 1 + seed % 3], 7)
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(2)] + [(5000, t, "user", str(t // 9)) for t in range(60)] + [(5100, t, "user", str(t // 9)) for t in range(40)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, None, None), (None, 0, "user", "no id"), (2001, 0, "user", "only")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 as s", "2 as w", "'x' as n")
    got = trie.nodes(trie.rebuilt(trie.sequences(df)), block=block).collect()
    want = brute_nodes(brute_rebuilt(rows))
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("texts", [[], [[]], [["a"], ["a"]], [["a", "b"], ["a"]], [[], ["a"]]])
def test_smallest_tries(spark, texts):
    seqs = {i: [("user", t) for t in x] for i, x in enumerate(texts)}
    s = lambda turns: "".join(hashlib.sha256(t.encode()).hexdigest()[: trie.DIGEST] + f"{len(t):08x}" for _, t in turns)
    df = spark.createDataFrame([(c, s(t) if t or c else None) for c, t in seqs.items()], "conv_id long, s string")
    assert {tuple(r) for r in trie.nodes(df, block=2).collect()} == brute_nodes(seqs)


def test_members_of_a_hot_sequence_in_pieces(spark):
    df = spark.createDataFrame([(i, "s" if i % 3 else "t") for i in range(500)], "conv_id long, s string")
    got = {r.s: (r.w, r.c, r.ends) for r in trie.classes(df, piece=7).collect()}
    for s, ids in (("s", [i for i in range(500) if i % 3]), ("t", list(range(0, 500, 3)))):
        assert got[s] == (len(ids), ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
