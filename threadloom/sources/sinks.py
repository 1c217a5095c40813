"""Sinks: JSON lines, delimited text, and a small manifest that is replaced as a whole."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str) -> list[dict]:
    """Entries of a manifest, none before its first write."""
    p, fs = _file(spark, path)
    return [json.loads(r.value) for r in spark.read.text(path).collect() if r.value] if fs.exists(p) else []


def append_manifest(spark: SparkSession, path: str, entry: dict) -> None:
    """Adds an entry: the new list is written beside the old one and renamed over it, so readers see either."""
    entries = [*read_manifest(spark, path), entry]
    p, fs = _file(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(aside, True)
    out.write(bytearray("".join(json.dumps(e) + "\n" for e in entries).encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(aside, p)
