"""Exact vector top-k: blocks of query vectors against blocks of targets.

Blocks have at most ``BLOCK_ROWS`` vectors on average, so their number follows the counted rows and what a task holds doesn't. Vectors
travel once per block row or column, a partition never holds more than two blocks, and each block pair keeps only its local top k
before the final merge, so the shuffle after scoring is ``queries x target blocks x k`` narrow rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "query_id long, target_id long, cosine double, dot double, euclidean double"


#: Vectors a block holds on average, and blocks a side has at least, for parallelism on small inputs.
BLOCK_ROWS, LEAST_BLOCKS = 50_000, 4


def block_count(df: DataFrame) -> int:
    return max(LEAST_BLOCKS, -(-df.count() // BLOCK_ROWS))


def topk(queries: DataFrame, targets: DataFrame, k: int, query_blocks: int | None = None, target_blocks: int | None = None, same_set: bool = True) -> DataFrame:
    """``queries``/``targets``: (id, vec array<double>). Returns (query_id, target_id, cosine, dot, euclidean, rank).

    Ordered by cosine descending, then target id; a row never matches itself when ``same_set``.
    Zero vectors score 0. Null vectors take no part. Block numbers are counted from the rows unless given.
    """
    query_blocks, target_blocks = query_blocks or block_count(queries), target_blocks or block_count(targets)
    q = queries.where("vec is not null").select(
        F.col("id").alias("query_id"), F.col("vec").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target_blocks - 1).cast("long"))).alias("tb"),
    )
    t = targets.where("vec is not null").select(
        F.col("id").alias("target_id"), F.col("vec").alias("tv"), F.pmod(F.xxhash64("id"), F.lit(target_blocks)).alias("tb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("qb"),
    )

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "target_id": [], "cosine": [], "dot": [], "euclidean": []})
        ids = right["target_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, b = ids[order], np.stack(right["tv"].to_numpy())[order].astype(float)
        nb, parts = np.sqrt((b * b).sum(1)), []
        for at in range(0, len(left), 512):
            own = left["query_id"].to_numpy()[at : at + 512]
            a = np.stack(left["qv"].to_numpy()[at : at + 512]).astype(float)
            na, prod = np.sqrt((a * a).sum(1)), a @ b.T
            scale = na[:, None] * nb[None, :]
            cos = np.divide(prod, scale, out=np.zeros_like(prod), where=scale > 0)
            ranked = np.round(cos, 9)
            if same_set:
                ranked[own[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-ranked, axis=1, kind="stable")[:, : k]
            rows, cols = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
            keep = np.isfinite(ranked[rows, cols])
            rows, cols = rows[keep], cols[keep]
            parts.append(pd.DataFrame({
                "query_id": own[rows], "target_id": ids[cols], "cosine": cos[rows, cols], "dot": prod[rows, cols],
                "euclidean": np.sqrt(((a[rows] - b[cols]) ** 2).sum(1)),
            }))
        return pd.concat(parts)

    pairs = q.groupBy("qb", "tb").cogroup(t.groupBy("qb", "tb")).applyInPandas(score, SCHEMA)
    by = Window.partitionBy("query_id").orderBy(F.round("cosine", 9).desc(), "target_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
