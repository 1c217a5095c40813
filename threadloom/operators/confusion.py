"""Confusion counts and the statistics on them; undefined ratios are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def counts(pairs: DataFrame, by: list[str], threshold: float = 0.0, strict: bool = True) -> DataFrame:
    """tp, fp, tn, fn by group; predicted where score is above the threshold."""
    yes = (F.col("score") > threshold) if strict else (F.col("score") >= threshold)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    gold = F.col("label") == 1
    return pairs.groupBy(*by).agg(n(yes & gold).alias("tp"), n(yes & ~gold).alias("fp"), n(~yes & ~gold).alias("tn"), n(~yes & gold).alias("fn"))


def statistics(found: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return found.select(
        "*", ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), specificity.alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"), ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )
