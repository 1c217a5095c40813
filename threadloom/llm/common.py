"""What the operators share: word splitting, the shared folder, tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import forget_at_exit

#: White space that separates words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: ``spark.checkpoint.dir``.

    Only where that is unset, and Spark runs in one local process (tests, notebooks), a temporary folder is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="threadloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and any executor can read it again. Deleted when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser does with projections."""
    return F.transform(F.array(value), body)[0]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is, for Spark to shuffle. df should be cheap to count."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def with_facts(rows: DataFrame, facts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows left-joined with facts, a row per key that says in ``n`` how many rows have it; facts should be a written table.

    Keys with over a fourth of a task's even share of the rows are at most four a shuffle partition, whatever the data: these are
    broadcast and their rows stay where they are, so no task gets a hot key. Others meet in a shuffle. Null keys match nothing.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total, most = facts.agg(F.sum(n), F.max(n)).first()
    share = (total or 0) // (4 * partitions)
    if (most or 0) <= max(share, 1):
        return rows.join(facts.drop(n), key, "left")
    hot = facts.where(F.col(n) > share)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col(n) <= share).drop(n), key, "left")
    return others.unionByName(rows.join(F.broadcast(hot.drop(n)), key))
