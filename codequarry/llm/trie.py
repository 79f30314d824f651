"""Prefix trie of conversations by a Cartesian tree over their sorted sequences.

Equal sequences of turns are merged first, and the distinct ones sorted. The
longest common prefixes of neighbours (LCP, in turns) are an array of borders;
an inner node of the trie is a maximal run of rows whose inner borders are not
below the node's depth, and a run ends at the nearest smaller border on each
side. Those are found by a stack within blocks of rows; what a block leaves open
is looked up by the blocks' least borders, first the block, then the border in
it. Borders of one run and one depth are one node. Between a node and its parent
lie the depths at which nothing branches; they are expanded at the end.

What a node says of its rows are differences of running sums (members, leaves,
tokens) and least values by blocks, so no row is copied once for each ancestor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.shared import stored
from codequarry.staging import numbered

#: Characters that stand for a turn in a sequence: its digest, and the length of its text.
DIGEST, WIDTH = 32, 40
#: Turns that a conversation can take over, and conversations between two that give them.
MOST_TAKEN, STEP = 6, 100
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, s): each conversation's turns in order, 40 hexadecimal digits each.

    By turn, null first; equal turns by role, then by digest. A null role or text is
    empty; rows with a null conv_id take no part; repeated rows are turns of their
    own. Texts stay where they are, only their digests are dealt out; all of one
    conversation's digests come together.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGEST), F.lpad(F.lower(F.hex(F.length(text))), WIDTH - DIGEST, "0"))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["digest"]), "").alias("s"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """(conv_id, s) in which the first h turns are those of conversation c - c % 100; h = crc32(c) % 6. May be turnless."""
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST_TAKEN).cast("int") * WIDTH
    base = seqs.where(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("base"), F.substring("s", 1, MOST_TAKEN * WIDTH).alias("head"))
    both = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % STEP).join(base, "base", "left")
    s = F.concat(F.substring(F.coalesce("head", F.lit("")), F.lit(1), h), F.substring("s", h + 1, F.length("s")))
    return both.select("conv_id", s.alias("s"))


def classes(members: DataFrame, piece: int = 4096) -> DataFrame:
    """(s, w, c, ends) of (conv_id, s): each distinct sequence, its members, the least one, and the digest of their ids in order.

    Rows are sorted by ranges of (s, conv_id), so that many members of one sequence
    go to several tasks. A sequence that lies within a task and within a piece is
    done there; of others, pieces of joined ids are brought together and hashed in
    order, one row for ``piece`` members.
    """
    kind = members.schema["conv_id"].dataType.simpleString()
    rows = members.repartitionByRange("s", "conv_id").sortWithinPartitions("s", "conv_id").select("s", "conv_id")
    names = ["s", "part", "whole", "w", "c", "text"]

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, made, now, ids, opens = TaskContext.get().partitionId() << 33, 0, None, [], False
        for pdf in batches:
            out = []
            for s, conv in zip(pdf["s"].tolist(), pdf["conv_id"].tolist()):
                if s != now or len(ids) == piece:
                    if now is not None:
                        made += 1
                        out.append((now, place + made, opens and s != now, len(ids), ids[0], ",".join(map(str, ids))))
                    opens, now, ids = now is not None and s != now, s, []
                ids.append(conv)
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([(now, place + made + 1, False, len(ids), ids[0], ",".join(map(str, ids)))], columns=names)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, w, c, ends = None, 0, 0, None
        for pdf in batches:
            out = []
            for s, n, least, text in zip(pdf["s"].tolist(), pdf["w"].tolist(), pdf["c"].tolist(), pdf["text"].tolist()):
                if s != now:
                    if now is not None:
                        out.append((now, w, c, ends.hexdigest()))
                    now, w, c, ends = s, 0, least, hashlib.sha256()
                ends.update(f",{text}".encode() if w else text.encode())
                w += n
            if out:
                yield pd.DataFrame(out, columns=["s", "w", "c", "ends"])
        if now is not None:
            yield pd.DataFrame([(now, w, c, ends.hexdigest())], columns=["s", "w", "c", "ends"])

    parts = stored(rows.mapInPandas(gathered, f"s string, part bigint, whole boolean, w bigint, c {kind}, text string"))
    cut = parts.where("not whole").repartition("s").sortWithinPartitions("s", "part").mapInPandas(hashed, f"s string, w bigint, c {kind}, ends string")
    return parts.where("whole").select("s", "w", "c", F.sha2("text", 256).alias("ends")).union(cut)


def _common(x: str, y: str) -> int:
    """Turns that both sequences begin with."""
    low, high = 0, min(len(x), len(y)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if x[low * WIDTH : mid * WIDTH] == y[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """Places of the nearest smaller values to the left and to the right; -1 and the length without one."""
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        left[i] = left[stack[-1]] if stack and values[stack[-1]] == v else stack[-1] if stack else -1
        stack.append(i)
    return left, right


class _Least:
    """Least values of ranges of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while len(values) > (step := 1 << (len(self.rows) - 1)):
            values = np.minimum(values[:-step], values[step:])
            self.rows.append(values)

    def over(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of [a, b); without values the largest number."""
        out = np.full(len(a), _NONE)
        size = np.asarray(b) - a
        for k, row in enumerate(self.rows):
            at = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << k)])
        return out


_ROW = "n bigint, b bigint, lcp int, nxt int, left bigint, right bigint, low bigint, pre bigint, suf bigint, ew bigint, el bigint, er bigint, len int, cum array<bigint>, ends string, c bigint, w bigint, leaf boolean, saved bigint"


def _block_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a block's rows say without other blocks; it comes with the row before and the row after."""
    pdf = pdf.sort_values("n")
    s, own = pdf["s"].tolist(), (pdf["b"] == pdf["at"]).to_numpy()
    first, n_own = int(own.argmax()), int(own.sum())
    if not n_own:  # past the last row
        return pd.DataFrame(columns=[x.split()[0] for x in _ROW.split(", ")])
    lcp = [_common(s[i - 1], s[i]) if i else -1 for i in range(len(s))][first:]
    lcp, nxt = lcp[:n_own], [*lcp[1:], -1][:n_own]
    pdf = pdf[own]
    s, n, c, w = s[first : first + n_own], pdf["n"].to_numpy(), pdf["c"].to_numpy(np.int64), pdf["w"].to_numpy()
    left, right = _nearest_smaller(lcp)
    low = _Least(c).over(np.maximum(left, 0), np.array(right))
    cum = [np.cumsum([0, *(int(x[k + DIGEST : k + WIDTH], 16) for k in range(0, len(x), WIDTH))]) for x in s]
    above = np.maximum(lcp, nxt)
    length = np.array([len(x) // WIDTH for x in s])
    leaf = length > above
    saved = np.array([(k - 1) * int(x[-1] - x[max(p, 0)]) if is_leaf else 0 for k, x, p, is_leaf in zip(w.tolist(), cum, above.tolist(), leaf.tolist())], dtype=np.int64)
    before = lambda x: np.cumsum(x) - x
    place = lambda at: pd.array([int(n[j]) if 0 <= j < n_own else None for j in at], dtype="Int64")
    return pd.DataFrame({
        "n": n, "b": pdf["b"].to_numpy(), "lcp": lcp, "nxt": nxt, "left": place(left), "right": place(right), "low": low,
        "pre": np.concatenate(([_NONE], np.minimum.accumulate(c)[:-1])), "suf": np.minimum.accumulate(c[::-1])[::-1], "ew": before(w), "el": before(leaf.astype(np.int64)), "er": before(saved),
        "len": length, "cum": cum, "ends": pdf["ends"].to_numpy(), "c": c, "w": w, "leaf": leaf, "saved": saved,
    })


def _borders(rows: DataFrame, block: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Rows with both nearest smaller borders and sums over all rows before, and a row past the last; the blocks' totals.

    A block's totals (a row for ``block`` sequences) come to the driver.
    """
    b = F.floor((F.col("n") - 1) / block).cast("bigint")
    near = F.array_compact(F.array(b, F.when(F.col("n") % block == 0, b + 1), F.when(((F.col("n") - 1) % block == 0) & (b > 0), b - 1)))
    local = stored(rows.select(b.alias("b"), "n", "s", F.col("w").cast("bigint").alias("w"), F.col("c").cast("bigint").alias("c"), "ends", F.explode(near).alias("at")).groupBy("at").applyInPandas(_block_rows, _ROW))
    totals = local.groupBy("b").agg(F.min("lcp").alias("lcp"), F.min("c").alias("c"), F.sum("w").alias("w"), F.count_if("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.count("*").alias("rows")).orderBy("b").toPandas()
    t = {c: totals[c].to_numpy(np.int64) for c in totals.columns}
    least, n_blocks, n_rows = t["lcp"].tolist(), len(t["b"]), int(t["rows"].sum())
    back, ahead = _nearest_smaller(least)

    def looked_up(side: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = []
                for at, v in zip(pdf["b"].tolist(), pdf["lcp"].tolist()):
                    x = at - 1 if side == "left" else at + 1
                    while 0 <= x < n_blocks and least[x] >= v:
                        x = back[x] if side == "left" else ahead[x]
                    found.append(x)
                yield pdf.assign(block=found)

        return run

    full = local
    for side, other, best in (("left", "right", F.max), ("right", "left", F.min)):
        asked = local.where(f"{side} is null and n > 1").select("b", "lcp").distinct().mapInPandas(looked_up(side), "b bigint, lcp int, block bigint")
        chain = local.where(f"{other} is null").groupBy(F.col("b").alias("block"), F.col("lcp").alias("v")).agg(best("n").alias("place"))
        found = asked.join(chain, "block", "left").where("v < lcp or v is null").groupBy("b", "lcp").agg(F.coalesce(best("place"), F.lit(n_rows + 1)).alias("place"))
        full = full.join(found, ["b", "lcp"], "left").withColumn(side, F.when(F.col("n") > 1, F.coalesce(side, "place"))).drop("place")
    sums = rows.sparkSession.createDataFrame(pd.DataFrame({"b": t["b"], **{k: np.cumsum(t[c]) - t[c] for k, c in (("bw", "w"), ("bl", "leaf"), ("br", "saved"))}}) if n_blocks else [], "b bigint, bw bigint, bl bigint, br bigint")
    full = full.join(sums, "b").withColumns({"ew": F.col("ew") + F.col("bw"), "el": F.col("el") + F.col("bl"), "er": F.col("er") + F.col("br")}).select(*local.columns)
    end = rows.sparkSession.createDataFrame([(n_rows + 1, n_blocks, -1, -1, None, None, _NONE, _NONE, _NONE, int(t["w"].sum()), int(t["leaf"].sum()), int(t["saved"].sum()), 0, None, None, _NONE, 0, False, 0)], _ROW)
    return stored(full.union(end)), t


def nodes(members: DataFrame, block: int = 16_384) -> DataFrame:
    """The trie's nodes of (conv_id, s): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is a bigint or int, each once. A null ``s`` is turnless. An empty table
    has no root. Memory is bounded by a block of rows and by the longest sequence.
    """
    rows, totals = _borders(numbered(stored(classes(members.select("conv_id", F.coalesce("s", F.lit("")).alias("s")))), "s"), block)
    inner = rows.where("left is not null").groupBy("left", "right", F.col("lcp").alias("depth")).agg(F.count("*").alias("borders"), F.min(F.struct("n", "b", "low")).alias("at"))
    inner = inner.select("left", "right", "depth", "borders", F.col("at.n").alias("rep"), F.col("at.b").alias("b"), F.col("at.low").alias("low"))
    ends = rows.where("leaf").select(F.col("n").alias("left"), (F.col("n") + 1).alias("right"), F.col("len").alias("depth"), F.lit(0).cast("bigint").alias("borders"), F.lit(None).cast("bigint").alias("rep"), "b", F.col("c").alias("low"))
    low_side = rows.select(F.col("n").alias("left"), *[F.col(c).alias(f"a_{c}") for c in ("b", "lcp", "left", "right", "suf", "ew", "el", "er", "len", "cum", "ends")])
    high_side = rows.select(F.col("n").alias("right"), *[F.col(c).alias(f"z_{c}") for c in ("b", "lcp", "left", "right", "pre", "ew", "el", "er")])
    both = inner.union(ends).join(low_side, "left").join(high_side, "right")
    parent = F.greatest("a_lcp", "z_lcp")
    by_left = F.col("a_lcp") >= F.col("z_lcp")
    from_ = F.greatest(parent, F.lit(0))
    both = both.select(
        "left", "right", "depth", "borders", "rep", "b", "a_b", "z_b", F.least("low", F.when(F.col("a_b") < F.col("b"), F.col("a_suf")), F.when(F.col("z_b") > F.col("b"), F.col("z_pre"))).alias("conv"),
        parent.alias("parent"), F.when(by_left, F.col("a_left")).otherwise(F.col("z_left")).alias("p_left"), F.when(by_left, F.col("a_right")).otherwise(F.col("z_right")).alias("p_right"),
        (F.col("z_ew") - F.col("a_ew")).alias("n_convs"), (F.col("z_el") - F.col("a_el")).alias("n_leaves"), (F.col("z_er") - F.col("a_er")).alias("saved"),
        F.slice("a_cum", from_ + 1, F.col("depth") - from_ + 1).alias("chars"), F.when(F.col("a_len") == F.col("depth"), F.col("a_ends")).alias("ends"),
    )
    columns = [c for c in both.columns if c not in ("b", "a_b", "z_b")]
    least = _Least(totals["c"])

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Least members of the blocks that lie wholly inside a node."""
        for pdf in batches:
            own, low, high = (pdf[c].to_numpy(np.int64) for c in ("b", "a_b", "z_b"))
            conv = np.minimum(pdf["conv"].to_numpy(np.int64), np.minimum(least.over(low + 1, own), least.over(own + 1, high)))
            yield pdf.assign(conv=conv)[columns]

    both = stored(both.mapInPandas(between, both.select(*columns).schema.simpleString().removeprefix("struct<").removesuffix(">")))
    # what inner nodes save, each at the first of its borders, summed up over the rows before
    chain = (F.col("n_convs") - 1) * (F.element_at("chars", -1) - F.element_at("chars", 1))
    at = rows.select("n", "b").join(both.where("rep is not null").select(F.col("rep").alias("n"), chain.alias("v")), "n", "left").na.fill(0, ["v"])
    at = stored(at.withColumn("upto", F.sum("v").over(Window.partitionBy("b").orderBy("n"))))
    by_block = at.groupBy("b").agg(F.max("upto").alias("v")).orderBy("b").collect()  # a row a block
    before = np.cumsum([0, *(r.v for r in by_block)])
    offset = members.sparkSession.createDataFrame([(r.b, int(x)) for r, x in zip(by_block, before.tolist())], "b bigint, offset bigint")
    at = at.join(offset, "b").select("n", (F.col("upto") + F.col("offset")).alias("upto"), (F.col("upto") + F.col("offset") - F.col("v")).alias("below"))
    both = both.join(at.select(F.col("n").alias("left"), F.col("upto").alias("i_left")), "left").join(at.select(F.col("n").alias("right"), F.col("below").alias("i_right")), "right")
    above = both.where("rep is not null").select(F.col("left").alias("p_left"), F.col("right").alias("p_right"), F.col("depth").alias("parent"), F.col("conv").alias("p_conv"))
    both = both.join(above, ["p_left", "p_right", "parent"], "left")
    from_ = F.greatest("parent", F.lit(0))
    d = F.col("d")
    out = both.withColumn("d", F.explode(F.sequence(F.greatest(F.col("parent") + 1, F.lit(0)), F.col("depth"))))
    last = d == F.col("depth")
    taken = (F.col("n_convs") - 1) * (F.element_at("chars", F.greatest(d - 1, F.lit(0)) - from_ + 1) - F.element_at("chars", 1))
    children = F.when(~last, 1).when(F.col("rep").isNull(), 0).otherwise(F.col("borders") + 1 - F.col("ends").isNotNull().cast("int"))
    return out.select(
        F.col("conv").alias("conv_id"), d.cast("bigint").alias("depth"), F.when(d > F.col("parent") + 1, F.col("conv")).when(d > 0, F.col("p_conv")).alias("parent_conv_id"), "n_convs",
        children.cast("bigint").alias("n_children"), "n_leaves", (F.col("saved") + F.col("i_right") - F.col("i_left") - taken).alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(_NO_ENDS))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"),
    )


SQL = f"""with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) pos from conversations where conv_id is not null),
c as (select conv_id, crc % 6 as h from (select distinct conv_id from t) join (select conv_id as k, list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint)), lambda a, x: xor((a >> 8), list_reduce(list_prepend((xor(a, x) & 255)::ubigint, range(8)::ubigint[]), lambda y, i: case when y & 1 = 1 then xor(y >> 1, 3988292384::ubigint) else y >> 1 end))) as raw, xor(raw, 4294967295::ubigint) as crc from (select distinct conv_id from t)) on k = conv_id),
r as (select c.conv_id, pos, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 where pos <= h union all select c.conv_id, pos, role, text from c join t on t.conv_id = c.conv_id where pos > h),
q as (select *, row_number() over (partition by conv_id order by pos) d from r),
f as (select conv_id, d as depth, list(sha256(role || chr(0) || text)) over (partition by conv_id order by d rows unbounded preceding) p, length(text) as chars from q union all select conv_id, 0, []::varchar[], 0 from c),
n as (select p, depth, min(conv_id) conv_id, count(*) n_convs, any_value(chars) chars from f group by p, depth),
e as (select p, depth, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) ends from (select conv_id, p, depth, max(depth) over (partition by conv_id) m from f) where depth = m group by p, depth),
k as (select p[1:depth - 1] as p, count(*) n_children from n where depth > 0 group by 1),
a as (select n.conv_id, n.n_convs, n.chars, n.p as own, n.p[1:i] as p from n, unnest(range(depth + 1)) u(i)),
s as (select a.p, count(*) filter (k.p is null) n_leaves, sum((n_convs - 1) * chars) saved from a left join k on k.p = a.own group by a.p)
select n.conv_id, n.depth::bigint as depth, u.conv_id parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::bigint n_children, s.n_leaves::bigint n_leaves, s.saved::bigint saved_tokens, coalesce(e.ends, '{_NO_ENDS}') ends_sha256
from n join s on s.p = n.p left join k on k.p = n.p left join e on e.p = n.p left join n u on n.depth > 0 and u.p = n.p[1:n.depth - 1]"""
