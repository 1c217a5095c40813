"""Ranking quality by query. A table of scored pairs has query, item, score and label (1 gold, 0 not)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(pairs: DataFrame) -> DataFrame:
    """Adds ``rank`` in the query: score descending, ties by item."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item")))


def _dcg(flag: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when((flag == 1) & (rank <= k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0))


def metrics(pairs: DataFrame, k: int = 5) -> DataFrame:
    """P@1, hit@k, MRR, recall@k and nDCG@k per query; the last three are null without gold items."""
    r, gold = F.col("rank"), F.col("label")
    agg = ranked(pairs).groupBy("query").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"), F.max(F.when(r == 1, gold)).cast("double").alias("p_at_1"),
        F.min(F.when(gold == 1, r)).alias("first"), F.sum(F.when(r <= k, gold).otherwise(0)).alias("found"), _dcg(gold, r, k).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_pos"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    some = F.col("n_pos") > 0
    return agg.select(
        "query", "n", "n_pos", "p_at_1", F.when(F.col("first") <= k, 1.0).otherwise(0.0).alias("hit"), F.when(some, 1.0 / F.col("first")).alias("mrr"),
        F.when(some, F.col("found") / F.col("n_pos")).alias("recall"), F.when(some, F.col("dcg") / ideal).alias("ndcg"),
    )


def sets_prf(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets as arrays; both empty gives 1, one empty 0."""
    hit, p, g = F.size(F.array_intersect(predicted, gold)), F.size(predicted), F.size(gold)
    both = (p == 0) & (g == 0)
    precision = F.when(both, 1.0).when(p > 0, hit / p).otherwise(0.0)
    recall = F.when(both, 1.0).when(g > 0, hit / g).otherwise(0.0)
    return precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def threshold_sweep(pairs: DataFrame, thresholds: list[float], strict: bool = False, top1_fallback: bool = True) -> DataFrame:
    """Mean precision, recall and F1 over queries at each threshold; an empty prediction may fall back to the best item."""
    over = (F.col("score") > F.col("threshold")) if strict else (F.col("score") >= F.col("threshold"))
    if top1_fallback:
        over = over | (F.col("rank") == 1)
    rows = ranked(pairs).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    per = rows.groupBy("query", "threshold").agg(
        F.sum(F.when(over, 1).otherwise(0)).alias("p"), F.sum("label").alias("g"), F.sum(F.when(over, F.col("label")).otherwise(0)).alias("hit"),
    )
    precision = F.when(F.col("p") > 0, F.col("hit") / F.col("p")).when(F.col("g") == 0, 1.0).otherwise(0.0)
    recall = F.when(F.col("g") > 0, F.col("hit") / F.col("g")).when(F.col("p") == 0, 1.0).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return per.groupBy("threshold").agg(F.count("*").alias("n_queries"), F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"))
