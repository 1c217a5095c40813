"""Resumable, idempotent ingestion: a file stream of triples into versioned node and edge tables.

A batch is written as a new version under its id; a batch that was cut off leaves no complete version and is done again, one that
was done is skipped, so restarts change nothing. Finished versions below the last two are free to be removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from threadloom.operators import graph


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            done.append(int(name[1:]))
    return sorted(done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version of a table, None before the first."""
    done = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{done[-1]}") if done else None


def upsert_batch(triples: DataFrame, batch: int, folder: str) -> None:
    """One batch into folder/nodes and folder/edges."""
    spark = triples.sparkSession
    for name, made, join in (
        ("nodes", graph.nodes_of(triples), graph.upsert_nodes),
        ("edges", graph.edges_of(triples), lambda old, new: old.union(new).distinct()),
    ):
        path = f"{folder}/{name}"
        done = _versions(spark, path)
        if batch in done:
            continue
        old = spark.read.parquet(f"{path}/v{done[-1]}") if done else None
        (join(old, made) if old is not None else made).write.mode("overwrite").parquet(f"{path}/v{batch}")


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, most_files: int = 100) -> StreamingQuery:
    """Starts a run over the files that no earlier run has finished, and ends when there are none left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, batch: upsert_batch(df, batch, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(units: DataFrame, finished: list[DataFrame], key: str) -> DataFrame:
    """What a resumed batch run has to do: units whose key is in none of the finished tables."""
    for f in finished:
        units = units.join(f.select(key).distinct(), key, "left_anti")
    return units


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts per event-time window for streams (and tables); rows later than ``late`` are dropped by the watermark."""
    from pyspark.sql import functions as F

    held = events.withWatermark(time, late) if events.isStreaming else events
    return held.groupBy(F.window(time, width, slide), *by).agg(F.count("*").alias("n"))
