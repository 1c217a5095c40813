"""Queries over ``embeddings``: top-k, ranking quality by label, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import vectors as V
from threadloom.operators.topk import topk
from threadloom.session import table

K = 5


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("vec"), "label")


def _top(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", "vec")
    return topk(v, v, k)


def vec_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("query_id", "target_id", F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


def vec_multi_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, dot and euclidean of each top-k pair."""
    return _top(spark, sf_dir).select("query_id", "target_id", F.round("cosine", 6).alias("cosine"), F.round("dot", 6).alias("dot"), F.round("euclidean", 6).alias("euclidean"))


def vec_p1_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P@1, Hit@3, Hit@5 and MRR@5 by label: a neighbour counts when it has the query's label."""
    labels = _vectors(spark, sf_dir).select("id", "label")
    hits = (
        _top(spark, sf_dir)
        .join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
        .join(labels.select(F.col("id").alias("target_id"), F.col("label").alias("tl")), "target_id")
        .groupBy("query_id", "ql")
        .agg(F.min(F.when(F.col("ql") == F.col("tl"), F.col("rank"))).alias("gold_rank"))
    )
    hit = lambda k: F.avg(F.when(F.col("gold_rank") <= k, 1.0).otherwise(0.0))
    return hits.groupBy(F.col("ql").alias("label")).agg(
        F.count("*").alias("n_queries"), F.round(hit(1), 6).alias("p_at_1"), F.round(hit(3), 6).alias("hit_at_3"), F.round(hit(5), 6).alias("hit_at_5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm before and after scaling to unit length."""
    v = _vectors(spark, sf_dir)
    return v.select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(V.norm(V.unit(F.col("vec"))), 6).alias("unit_norm"))


_TOP_SQL = f"""
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
p AS (SELECT a.id AS query_id, b.id AS target_id, a.label AS ql, b.label AS tl,
             list_cosine_similarity(a.vec, b.vec) AS cosine, list_inner_product(a.vec, b.vec) AS dot, list_distance(a.vec, b.vec) AS euclidean
      FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, target_id) AS rank FROM p QUALIFY rank <= {K})
"""

QUERIES = {"vec_topk_cosine": vec_topk_cosine, "vec_multi_metric": vec_multi_metric, "vec_p1_hit_mrr": vec_p1_hit_mrr, "vec_normalize": vec_normalize}
ORACLE = {
    "vec_topk_cosine": _TOP_SQL + "SELECT query_id, target_id, rank, round(cosine, 6) AS cosine FROM t",
    "vec_multi_metric": _TOP_SQL + "SELECT query_id, target_id, round(cosine, 6) AS cosine, round(dot, 6) AS dot, round(euclidean, 6) AS euclidean FROM t",
    "vec_p1_hit_mrr": _TOP_SQL + """, h AS (SELECT query_id, ql, min(CASE WHEN ql = tl THEN rank END) AS g FROM t GROUP BY ALL)
        SELECT ql AS label, count(*) AS n_queries, round(avg(CASE WHEN g <= 1 THEN 1.0 ELSE 0.0 END), 6) AS p_at_1,
               round(avg(CASE WHEN g <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3, round(avg(CASE WHEN g <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5,
               round(avg(coalesce(1.0::DOUBLE / g, 0.0)), 6) AS mrr FROM h GROUP BY ql""",
    "vec_normalize": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings),
        n AS (SELECT vec_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM v)
        SELECT vec_id, round(norm, 6) AS norm, round(CASE WHEN norm > 0 THEN sqrt(list_sum(list_transform(vec, lambda x: (x / norm) * (x / norm)))) ELSE 0.0 END, 6) AS unit_norm FROM n""",
}
