"""Ranked candidate pools: a verdict per query, means over groups of queries, and hits, precision and coverage by depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.curves import by_score
from threadloom.operators.ranking import ranked

VERDICTS = {"p1": "correct", "p1_plus": "correct_plus", "hit3": "hit3", "hit5": "hit5", "mrr": "rr", "gold_in_pool_rate": "gold_in_pool"}


def evaluate_pool(pairs: DataFrame, parent: DataFrame | None = None, tactics: DataFrame | None = None) -> DataFrame:
    """pairs(query, item, score, label) -> a row per query: the best item, whether it, or what it rolls up to, is gold, hits at 3 and 5, the first
    gold rank, its reciprocal (0 without one).

    parent(id, parent) and tactics(id, tactic) are the taxonomy: an item rolls up to its parent, to its own tactics and to its parent's.
    Ties go by item. Gold items are those with label 1.
    """
    r, gold = F.col("rank"), F.col("label") == 1
    per = ranked(pairs).groupBy("query").agg(
        F.count("*").alias("pool_size"), F.max(gold).alias("gold_in_pool"), F.max(F.when(r == 1, F.struct("item", "score", "label"))).alias("b"), F.min(F.when(gold, r)).alias("gold_rank"),
    )
    out = per.select("query", "pool_size", "gold_in_pool", F.col("b.item").alias("predicted"), F.col("b.score").alias("predicted_score"), (F.col("b.label") == 1).alias("correct"), "gold_rank")
    out = out.withColumns({"hit3": F.coalesce(F.col("gold_rank") <= 3, F.lit(False)), "hit5": F.coalesce(F.col("gold_rank") <= 5, F.lit(False)), "rr": F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0))})
    best = out.select("query", F.col("predicted").alias("id"))
    wider = best
    if parent is not None:
        above = best.join(parent, "id").select("query", F.col("parent").alias("id"))
        wider = wider.union(above)
    if tactics is not None:
        wider = wider.union(wider.join(tactics, "id").select("query", F.col("tactic").alias("id")))
    plus = wider.join(pairs.where("label = 1").select("query", F.col("item").alias("id")), ["query", "id"], "left_semi").select("query").distinct().withColumn("plus", F.lit(True))
    return out.join(plus, "query", "left").withColumn("correct_plus", F.coalesce("plus", F.lit(False))).drop("plus")


def aggregate(verdicts: DataFrame, key: Column | Callable[[DataFrame], Column] | None = None, digits: int = 4) -> DataFrame:
    """Means of the verdicts per group; ``key`` is a column, or a function of the table that gives one. Without a key, one group 'all'."""
    group = F.lit("all") if key is None else key(verdicts) if callable(key) and not isinstance(key, Column) else key
    means = [F.round(F.avg(F.col(c).cast("double")), digits).alias(name) for name, c in VERDICTS.items()]
    return verdicts.groupBy(group.alias("group")).agg(F.count("*").alias("n"), *means)


def ids_by_k(top: DataFrame, ks: list[int]) -> DataFrame:
    """top(query, rank, item) -> (k, item): the distinct items of all queries within each depth, trimmed and upper-cased; blank items are none."""
    own = top.withColumn("item", F.upper(F.trim("item"))).where("item <> ''")
    return own.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").select("k", "item").distinct()


def metrics_by_k(top: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """top(query, rank, item) against one set of gold(item), by depth: the share of queries with a gold item, the shares of returned items that are
    gold and that aren't, and the share of gold items that some query returns. Queries without an item aren't counted."""
    own = top.withColumn("item", F.upper(F.trim("item"))).where("item <> ''")
    g = gold.select(F.upper(F.trim("item")).alias("item")).distinct().withColumn("gold", F.lit(1))
    marked = own.join(g, "item", "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    per = marked.groupBy("k", "query").agg(F.count("*").alias("n"), F.count("gold").alias("tp"))
    sums = per.groupBy("k").agg(F.count("*").alias("queries"), F.sum((F.col("tp") > 0).cast("long")).alias("hits"), F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    covered = ids_by_k(top, ks).join(g, "item").groupBy("k").agg(F.count("*").alias("covered"))
    total = g.agg(F.count("*").alias("total"))
    depth = top.sparkSession.createDataFrame([(k,) for k in ks], "k int").join(F.broadcast(total))  # one row
    joined = depth.join(sums, "k", "left").join(covered, "k", "left").na.fill(0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return joined.select("k", share("hits", "queries").alias("hit"), share("tp", "n").alias("precision"), F.when(F.col("n") > 0, (F.col("n") - F.col("tp")) / F.col("n")).otherwise(0.0).alias("spurious"), share("covered", "total").alias("recall"), "queries")


def leaderboard(top: DataFrame, gold: DataFrame, by: str, ks: list[int]) -> DataFrame:
    """metrics_by_k of each value of ``by`` (a report, a run), which both tables have: hit, precision and coverage, best coverage first in rank."""
    own, g = top.withColumn("item", F.upper(F.trim("item"))).where("item <> ''"), gold.select(by, F.upper(F.trim("item")).alias("item")).distinct().withColumn("gold", F.lit(1))
    marked = own.join(g, [by, "item"], "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
    per = marked.groupBy(by, "k", "query").agg(F.count("*").alias("n"), F.count("gold").alias("tp"))
    sums = per.groupBy(by, "k").agg(F.count("*").alias("queries"), F.avg((F.col("tp") > 0).cast("double")).alias("hit"), (F.sum("tp") / F.sum("n")).alias("precision"))
    covered = marked.where("gold = 1").groupBy(by, "k").agg(F.countDistinct("item").alias("covered"))
    total = g.groupBy(by).agg(F.count("*").alias("total"))
    return sums.join(covered, [by, "k"], "left").join(total, by, "left").select(by, "k", "queries", "hit", "precision", F.coalesce(F.col("covered") / F.col("total"), F.lit(0.0)).alias("recall"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """(threshold, precision, recall) per distinct score, ties as one point, and the end point (infinity, 1, 0); only that without positives."""
    total = pairs.agg(F.sum("label").alias("p"))
    points = by_score(pairs).join(F.broadcast(total)).where("p > 0")  # one row
    curve = points.select(F.col("score").cast("double").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))
    return curve.union(pairs.sparkSession.createDataFrame([(float("inf"), 1.0, 0.0)], curve.schema))


def grouped_metric(pairs: DataFrame, by: list[str], metric: Callable[[list, list], float]) -> DataFrame:
    """metric(scores, labels) of each group, a function of two lists: a user's own statistic. What a call sees is one group."""

    def run(pdf):
        import pandas as pd

        own = pdf.sort_values(["score", "label"], ascending=[False, True])
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], float(metric(own["score"].tolist(), own["label"].tolist()))]], columns=[*by, "value"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*by, "score", "label").groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", value double")


def grouped_statistic(values: DataFrame, by: list[str], value: str, statistic: Callable[[list], float]) -> DataFrame:
    """statistic(list) of each group's values in order; the groups must be small enough for a call each."""
    return values.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v")).select(*by, F.udf(lambda v: float(statistic(v)), "double")("v").alias("value"))
