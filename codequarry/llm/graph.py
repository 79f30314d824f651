"""Connected components of a link table by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.shared import ready_checkpoints, stored


def components(links: DataFrame) -> DataFrame:
    """Vertices of ``links`` (a, b: same orderable type) with the smallest vertex that each reaches: (v, root).

    Each pass is one aggregation for the least neighbour and one join; a vertex
    with very many neighbours only has its least one aggregated map-side. The least
    neighbours are written first, so that both sides of the join are dealt for it
    alone and adaptive execution may split the neighbours of a hot vertex. The
    number of passes grows with the logarithm of the longest path. Null ends
    and self-links are left out; an empty table gives an empty table.
    """
    ready_checkpoints(links.sparkSession)
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct().checkpoint()
    seen = None
    while True:
        both = edges.union(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = stored(both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        large = stored(large)
        least = stored(large.groupBy("u").agg(F.min("w").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.greatest("w", "m").alias("u"), F.col("m").alias("w")), F.struct("u", F.col("m").alias("w")))).alias("e")).select("e.*").where("u <> w").distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("v"), F.col("w").alias("root")).union(edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
