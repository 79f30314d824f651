"""The chunk plan carried out, against plain Python."""

import hashlib
import random

import pytest

from codequarry.operators import chunking as C
from codequarry.operators import extract as X


def programs():
    rng = random.Random(7)
    body = lambda n: "\n".join(f"           MOVE {i} TO X{rng.randrange(99)}." for i in range(n))
    out = [("small.cbl", "one\ntwo"), ("empty.cbl", ""), ("plain.txt", "\n".join(f"row {i}" for i in range(95)))]
    for k, sizes in enumerate(([5, 9, 3, 20, 7], [1, 2, 60, 3], [12] * 9, [2] * 30)):
        head = f"       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P{k}.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 A PIC X.\n"
        parts = [f"       PART-{i} SECTION.\n       PARA-{i}.\n{body(n)}" for i, n in enumerate(sizes)]
        out.append((f"p{k}.cbl", head + "       PROCEDURE DIVISION.\n" + "\n".join(parts)))
    return out


def by_hand(sources, units, max_lines, overlap, max_tokens):
    rank = {"division": 3, "section": 2, "data section": 2, "paragraph": 1}
    out = {}
    for file, content in sources:
        lines = content.split("\n")
        own = sorted((u for u in units if u.file == file), key=lambda u: (["division", "data section", "section", "paragraph"].index(u.kind), u.start_line))
        size = lambda u: u.end_line - u.start_line + 1
        if len(lines) <= max_lines:
            found = [(1, len(lines), None)]
        elif not own or any(size(u) > max_lines for u in own):
            step = max_lines - overlap
            found = [(i * step + 1, min(i * step + max_lines, len(lines)), None) for i in range(max(1, -(-len(lines) // step)))]
        else:
            chunks, held = [], []
            for u in own:
                total = lambda us: (sum(x.chars // 4 for x in us), sum(map(size, us)))
                t, n = total([*held, u])
                over = t > max_tokens or n > max_lines
                if over and held:
                    cut = max(range(len(held)), key=lambda i: (rank[held[i].kind], i)) + 1
                    chunks.append(held[:cut])
                    held = [*held[cut:], u]
                elif over:
                    chunks.append([u])
                else:
                    held.append(u)
            chunks += [held] if held else []
            found = [(min(u.start_line for u in c), max(u.end_line for u in c), [u.unit for u in c]) for c in chunks]
        for i, (a, b, ids) in enumerate(found):
            before = "\n".join(lines[max(1, a - overlap) - 1 : a - 1]) if i else None
            out[file, i] = (len(found), a, b, "\n".join(lines[a - 1 : b]), before or None, ids)
    return out


@pytest.mark.parametrize("max_lines,overlap,max_tokens", [(40, 6, 10_000), (90, 5, 150), (30, 0, 10_000), (1500, 300, 28_000)])
def test_plan_like_by_hand(spark, max_lines, overlap, max_tokens):
    rows = programs()
    sources = spark.createDataFrame(rows, "file string, content string")
    units = X.units(sources).collect()
    chunks = C.plan(sources, max_lines, overlap, max_tokens)
    got = {(r.file, r.chunk): r for r in C.with_texts(chunks, sources, overlap).collect()}
    want = by_hand(rows, units, max_lines, overlap, max_tokens)
    assert got.keys() == want.keys()
    for k, (n, a, b, text, before, ids) in want.items():
        r = got[k]
        assert (r.total_chunks, r.start_line, r.end_line, r.before or None) == (n, a, b, before), k
        assert hashlib.md5((r.content or "").encode()).hexdigest() == hashlib.md5(text.encode()).hexdigest()
        if ids is not None:
            assert r.way == "semantic" and list(r.units) == ids
        else:
            assert set(r.units) == {u.unit for u in units if u.file == k[0] and u.start_line <= b and u.end_line >= a}


def test_chunking_switched_off(spark):
    sources = spark.createDataFrame(programs(), "file string, content string")
    assert {(r.way, r.chunk, r.total_chunks) for r in C.plan(sources, 10, 2, 100, enabled=False).collect()} == {("single", 0, 1)}
