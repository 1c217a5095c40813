"""ROC and precision-recall curves, their areas, points on them, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.running import running


def by_score(pairs: DataFrame) -> DataFrame:
    """A row per distinct score: positives and negatives there, and at it or above."""
    groups = pairs.groupBy("score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    return running(groups, "score", [F.desc("score")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, descending=True)


def roc(pairs: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr), ties as one point, without the origin."""
    total = pairs.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    points = by_score(pairs).join(F.broadcast(total))  # one row
    return points.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def auroc(pairs: DataFrame) -> DataFrame:
    """Area under ROC: positives above negatives, ties half. Null without both classes."""
    s = by_score(pairs).agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select((F.col("wins") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auroc"))


def auprc(pairs: DataFrame) -> DataFrame:
    """Average precision, ties not collapsed: score descending, then item."""
    order = [F.desc("score"), F.col("item")]
    rows = running(pairs.select("score", "item", "label"), "score", order, {"seen": ("sum", F.lit(1)), "tp": ("sum", F.col("label"))}, descending=True)
    hit = F.col("label") == 1
    return rows.agg((F.sum(F.when(hit, F.col("tp") / F.col("seen"))) / F.sum(F.when(hit, 1))).alias("auprc"))


def _interpolate(points: DataFrame, x: str, y: str, targets: list[float], name: str) -> DataFrame:
    """y at targets of x between the last point at or before one and the first beyond it; (0, 0) is the first point."""
    parts = None
    for t in targets:
        pair = F.struct(x, y)
        bracket = points.agg(F.max(F.when(F.col(x) <= t, pair)).alias("lo"), F.min(F.when(F.col(x) > t, pair)).alias("hi"))
        x0, y0 = F.coalesce(F.col(f"lo.{x}"), F.lit(0.0)), F.coalesce(F.col(f"lo.{y}"), F.lit(0.0))
        x1, y1 = F.col(f"hi.{x}"), F.col(f"hi.{y}")
        part = bracket.select(F.lit(name).alias("kind"), F.lit(t).alias("target"), F.when(F.col("hi").isNull(), y0).otherwise(y0 + (y1 - y0) * (t - x0) / (x1 - x0)).alias("value"))
        parts = part if parts is None else parts.union(part)
    return parts


def operating_points(pairs: DataFrame, targets: list[float]) -> DataFrame:
    """TPR at given FPRs and FPR at given TPRs."""
    points = roc(pairs)
    return _interpolate(points, "fpr", "tpr", targets, "tpr_at_fpr").union(_interpolate(points, "tpr", "fpr", targets, "fpr_at_tpr"))


def brier(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"))


def ece(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal count, cut at floor(n i / bins) of the order by p, then item."""
    n = pairs.agg(F.count("*").alias("total"))
    rows = running(pairs.select("p", "item", "label"), "p", [F.asc("p"), F.col("item")], {"place": ("sum", F.lit(1))})
    rows = rows.join(F.broadcast(n))  # one row
    edges = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.floor(F.col("total") * i / bins))
    held = rows.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("place"))))
    per = held.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("label").alias("acc"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))
