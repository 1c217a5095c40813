"""Registry of the reference-side queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import assembling, entities, evaluation, experimenting, explanations, extraction, graphs, inference, pooling, retrieval, sets, texts, units, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

for _module in (assembling, entities, evaluation, experimenting, explanations, extraction, graphs, inference, pooling, retrieval, sets, texts, units, vectors):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
