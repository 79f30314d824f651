"""Filters and projections over the metadata tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_run(df: DataFrame, run_id: int, file: str | None = None) -> DataFrame:
    """Rows of a run, and of one file if named; the filter reaches a run-partitioned scan."""
    df = df.where(F.col("run_id") == run_id)
    return df if file is None else df.where(F.col("source_file") == file)


def search(files: DataFrame, term: str | None) -> DataFrame:
    """Files whose name or content holds ``term``, without regard to ASCII case; a blank term keeps all. % and _ are wildcards."""
    if not (term or "").strip():
        return files
    return files.where(F.col("file_name").ilike(f"%{term}%") | F.col("content").ilike(f"%{term}%"))


def mentions(df: DataFrame, column: str, *terms: str) -> DataFrame:
    """Rows whose ``column`` holds any of the terms, without regard to case."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.col(column).ilike(f"%{t}%")
    return df.where(hit)


def recent(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` latest rows that have a value in ``column``; ``ties`` order equal values."""
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), *ties).limit(n)


def before_chunk(chunks: DataFrame, n: int) -> DataFrame:
    return chunks.where(F.col("chunk_index") < n)


def defaulted(df: DataFrame, **values) -> DataFrame:
    """Null replaced by a default, column by column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def unresolved(refs: DataFrame) -> DataFrame:
    return refs.where(~F.col("resolved"))


def target_language(output: Column) -> Column:
    """C# if the output path names csharp, Java if it names java or is the plain ``output``, else null."""
    low = F.lower(output)
    return F.when(low.contains("csharp"), "C#").when(low.contains("java") | (low == "output"), "Java")


def one_each(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order; the order should be total."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def visible_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges of shown types whose ends are both among ``nodes`` (file)."""
    shown = nodes.select("file").distinct()
    kept = edges.where(F.col("dependency_type").isin(types))
    kept = kept.join(shown.withColumnRenamed("file", "source_file"), "source_file", "left_semi")
    return kept.join(shown.withColumnRenamed("file", "target_file"), "target_file", "left_semi")


#: Bits of the table of hashes that texts are held against before they are joined: 1 MB, whatever the input's size.
_BITS = 1 << 23


def _hashes(text: str, n: int) -> np.ndarray:
    """A hash of each ``n`` characters in a row of ``text``, as a place in a table of bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
    for i in range(n if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)] + np.uint64(1)
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS.bit_length() + 1)


def mentioned(prompts: DataFrame, files: DataFrame, most: int = 5, key: int = 6) -> DataFrame:
    """(prompt, file_name): the first ``most`` files by name whose name or stem a prompt's text holds, whatever the case.

    Stems and texts meet by the stem's last ``key`` characters (all of a shorter one)
    before the stem is looked for. Of a text's characters in a row only those go
    into the join whose hash is that of a stem's, with the text before them as far
    as the longest stem goes; that side is not broadcast, as it may be far larger
    than the texts.
    """
    from pyspark.sql import Window

    f = files.select("file_name", F.regexp_replace(F.lower("file_name"), r"\.[^.]*$", "").alias("stem")).withColumn("k", F.expr(f"right(stem, {key})"))
    found = f.groupBy(F.length("k").alias("n")).agg(F.max(F.length("stem")).alias("longest")).where("n > 0").collect()  # at most ``key`` rows
    sizes, longest = sorted(r.n for r in found), max((r.longest for r in found), default=0)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([_hashes(k, len(k))[0] for k in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    table = np.zeros(_BITS // 8, np.uint8)
    for r in f.select("k").where("k <> ''").distinct().mapInArrow(marked, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        table.view("<i8")[r.word] = r.bits

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for prompt, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n in sizes:
                    h = _hashes(t, n).astype(np.int64)
                    for i in np.flatnonzero((table[h >> 3] >> (h & 7).astype(np.uint8)) & 1).tolist():
                        out[0].append(prompt)
                        out[1].append(t[i : i + n])
                        out[2].append(t[max(0, i + n - longest) : i + n])
            table_ = pa.table({c: pa.array(v, pa.string()) for c, v in zip(("prompt", "k", "upto"), out)})
            yield from table_.to_batches(max_chunksize=50_000)

    text = prompts.select(F.col("prompt").cast("string").alias("prompt"), F.lower("text").alias("t")).where("t is not null")
    places = text.mapInArrow(looked, "prompt string, k string, upto string").distinct()
    hits = places.join(f.hint("merge"), "k").where(F.col("upto").endswith(F.col("stem"))).select("prompt", "file_name").distinct()
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("prompt").orderBy("file_name"))).where(F.col("n") <= most).select("prompt", "file_name")


#: Dependency types that read or write data.
DATA_ACCESS = ("EXEC SQL", "EXEC CICS", "READ", "WRITE", "OPEN", "CLOSE")


def data_access(edges: DataFrame, types=DATA_ACCESS) -> DataFrame:
    return edges.where(F.upper("dependency_type").isin(*types))
