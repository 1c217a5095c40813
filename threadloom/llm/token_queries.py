"""Queries of the operators on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import packing, token_counts
from threadloom.llm.common import read


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat files that its text was written to."""
    files, roster = token_counts.write_token_files(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.named(token_counts.document_lengths(files), roster)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048."""
    pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_token_counts": op5_token_counts, "op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
