"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges``: (a long, b long), any order, repeats allowed. Returns (node, root) for every node of an edge, root the least node reachable.

    Both stars are joins of the edges with one minimum per node: the minimum is combined map-side and the join is one
    that Spark may split, so a node with a large share of the links is no hot task. Rounds grow with the logarithm of
    the longest chain.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    for _ in range(most_rounds):
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before or not size[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = tuple(size)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = materialise(small.union(least).distinct(), "links")
    raise RuntimeError("components did not settle")
