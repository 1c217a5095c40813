"""Splits and samples by hash draws, which any run and any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators.running import running


def stratified_split(rows: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """rows(id, stratum) with split: per stratum, in the order of a draw, floors of the shares go to train and val, the rest to test.

    Places are running counts over ranges of the draw, so a stratum that holds most rows is still many tasks.
    """
    drawn = rows.withColumn("draw", X.hash_draw(F.lit(seed), F.col("id")))
    placed = running(drawn, "draw", [F.asc("draw"), F.col("id")], {"k": ("sum", F.lit(1))}, partition=["stratum"])
    sizes = rows.groupBy(F.col("stratum").alias("_s")).agg(F.count("*").alias("n"))
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("k") <= n_train, "train").when(F.col("k") <= n_train + n_val, "val").otherwise("test")
    return placed.join(sizes, F.col("stratum").eqNullSafe(F.col("_s"))).select("id", "stratum", split.alias("split"))


def training_pairs(pairs: DataFrame, ratio: float, seed: int) -> DataFrame:
    """All positives of pairs(query, item, label) and per query the floor(ratio * positives) negatives of least draw."""
    drawn = pairs.withColumn("draw", X.hash_draw(F.lit(seed), F.col("query"), F.col("item")))
    k = F.row_number().over(Window.partitionBy("query", "label").orderBy("draw", "item"))
    positives = F.sum("label").over(Window.partitionBy("query"))
    rows = drawn.withColumns({"k": k, "pos": positives})
    return rows.where((F.col("label") == 1) | (F.col("k") <= F.floor(ratio * F.col("pos")))).select("query", "item", "label")
