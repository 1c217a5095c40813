"""Session helper for tests, benches and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with AQE on; a cluster brings its own configuration instead."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("threadloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a temporary one only for a single local process without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> str:
    """Has Hadoop delete a path that is there when the driver's JVM ends: results that are still to be read may need it until then."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, tag: str, folder: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and what follows computes it once. Deleted when the driver ends."""
    path = f"{folder or scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Prepares a session for Python workers, once per application: sends this package, so that it need not be installed there, and, where
    the session has Spark's default, bounds Arrow batches by fewer rows, since a row may be a long text."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root, path = Path(__file__).parent, f"{tempfile.mkdtemp()}/{Path(__file__).parent.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as made:
            for file in sorted(root.rglob("*.py")):
                made.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder, by any path Spark can read."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
