"""Query of the decontamination operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate
from threadloom.llm.common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it leaks."""
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.withColumn("similarity", F.round(F.col("matched") / F.col("item_words"), 6))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
