r"""Token counts from flat token files by a separator scan.

A token file is a run of little-endian unsigned 16-bit ids in which an end-of-document id follows each document; nothing
says where documents start. Files are read in blocks of fixed size that know nothing of document borders:

1. every block searches its ids for the separator in one vectorised pass, and gives the lengths between its separators,
   the place of its last one, and how many ids and separators it has;
2. an exclusive prefix scan over these few numbers per block (running sums of ids and separators, running maximum of
   the last separator's place) tells each block the number of documents before it and how much of its first
   document lies in earlier blocks;
3. each block's first length is stitched with that carry.

``write_token_files`` makes such files from documents, in the shared folder, and beside them a roster of which documents went into a
file in which order, with no places or lengths; ``read_flat_files`` takes binary files as they are. Defined results: null text is a
document of 0 tokens; empty files give no rows; ids after the last separator are a document that is not terminated; very long
texts lie across as many blocks as they need; null, repeated and equal ids keep their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import materialise
from threadloom.llm.tokens import encoder
from threadloom.session import ship

SEPARATOR, BLOCK_IDS = 50256, 1 << 16
ROSTER = 4096
WRITTEN = "file long, block long, payload binary, doc_ids array<bigint>"
RECORDS = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def write_token_files(docs: DataFrame, vocabulary: str | None = None, separator: int = SEPARATOR) -> tuple[DataFrame, DataFrame]:
    """A token file per partition, as blocks (file, block, payload), and the roster (file, first, doc_ids): the documents from place ``first``
    on. Both lie in one table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        of, file, block = encoder(vocabulary), TaskContext.get().partitionId(), 0
        parts, size, named, first = [], 0, [], 0

        def row(at: int, payload: bytes | None, doc_ids: list | None) -> pa.RecordBatch:
            columns = [pa.array([file], pa.int64()), pa.array([at], pa.int64()), pa.array([payload], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "payload", "doc_ids"])

        def out(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, size, block
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype="<u2")
            at = 0
            while len(flat) - at >= BLOCK_IDS or (whole and at < len(flat)):
                yield row(block, flat[at : at + BLOCK_IDS].tobytes(), None)
                block, at = block + 1, at + BLOCK_IDS
            parts = [flat[at:]]
            size = max(0, len(flat) - at)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*of.encode(text.as_py()), separator], dtype="<u2")
                parts.append(ids)
                named.append(doc_id.as_py())
                size += len(ids)
                if len(named) == ROSTER:
                    yield row(first, None, named)
                    first, named = first + ROSTER, []
                if size >= 8 * BLOCK_IDS:
                    yield from out(False)
        yield from out(True)
        if named:
            yield row(first, None, named)

    ship(docs.sparkSession)
    written = materialise(docs.select("doc_id", "text").mapInArrow(run, WRITTEN), "token-files")
    blocks = written.where("payload is not null").select("file", "block", "payload")
    return blocks, written.where("doc_ids is not null").select("file", F.col("block").alias("first"), "doc_ids")


def read_flat_files(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, whole_bytes: int = 1 << 28) -> DataFrame:
    """Blocks (file, block, payload) of binary token files by any path Spark can read; ``file`` is the path.

    Files up to ``whole_bytes`` are read whole and cut. A larger one is read in ranges by as many tasks as it has splits, in records of
    the longest length up to a block that divides it; each such file is a branch of the plan, so lay many of them down as Parquet blocks.
    """
    size = 2 * block_ids
    listed = spark.read.format("binaryFile").load(path)
    cut = F.expr(f"transform(sequence(0, cast((length - 1) div {size} as int)), k -> substring(content, k * {size} + 1, {size}))")
    whole = listed.where(F.col("length").between(1, whole_bytes))
    blocks = whole.select(F.col("path").alias("file"), F.posexplode(cut).alias("block", "payload")).withColumn("block", F.col("block").cast("long"))
    for file, length in listed.where(F.col("length") > whole_bytes).select("path", "length").collect():
        record = 2 * max(d for k in range(1, int((length // 2) ** 0.5) + 1) if length // 2 % k == 0 for d in (k, length // 2 // k) if d <= block_ids)
        rows = spark.sparkContext.newAPIHadoopFile(file, RECORDS, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{RECORDS}.recordLength": str(record)})
        blocks = blocks.union(spark.createDataFrame(rows, "block long, payload binary").select(F.lit(file), "block", "payload"))
    return blocks


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Each block's numbers: n_ids, n_seps, last (place of the last separator in the block, -1 if none) and ``lengths`` up to each separator."""
    others = [f for f in blocks.schema.fields if f.name != "payload"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", n_ids long, n_seps long, last long, lengths array<bigint>"
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            at = [np.frombuffer(p.as_py() or b"", dtype="<u2") for p in batch.column(batch.schema.get_field_index("payload"))]
            seps = [np.flatnonzero(x == separator) for x in at]
            lengths = [np.diff(s, prepend=-1) - 1 for s in seps]
            numbers = [pa.array([len(x) for x in at], pa.int64()), pa.array([len(s) for s in seps], pa.int64()), pa.array([int(s[-1]) if len(s) else -1 for s in seps], pa.int64()), pa.array([x.tolist() for x in lengths], pa.list_(pa.int64()))]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *numbers], names=[*names, "n_ids", "n_seps", "last", "lengths"])

    ship(blocks.sparkSession)
    return blocks.mapInArrow(run, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """Adds, by an exclusive prefix scan in each file, ``before`` (documents that ended in earlier blocks) and ``carry``
    (ids of the block's first document in earlier blocks), and adds the carry to its first length.

    Only four numbers a block go through the scan; lengths meet the result again by file and block."""
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = scanned.select("file", "block", "n_ids", "n_seps", "last").withColumn("base", F.coalesce(F.sum("n_ids").over(upto), F.lit(0)))
    placed = placed.withColumn("ended", F.when(F.col("last") >= 0, F.col("base") + F.col("last")))
    placed = placed.withColumn("before", F.coalesce(F.sum("n_seps").over(upto), F.lit(0))).withColumn("carry", F.col("base") - 1 - F.coalesce(F.max("ended").over(upto), F.lit(-1)))
    placed = scanned.select("file", "block", "lengths").join(placed, ["file", "block"])
    return placed.withColumn("lengths", F.transform("lengths", lambda x, i: F.when(i == 0, x + F.col("carry")).otherwise(x)))


def document_lengths(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, n_tokens) of the terminated documents of token files."""
    placed = stitch(materialise(scan_blocks(blocks, separator), "separator-scan"))
    rows = placed.select("file", "before", F.posexplode("lengths").alias("k", "n_tokens"))
    return rows.select("file", (F.col("before") + F.col("k")).alias("ordinal"), "n_tokens")


def named(lengths: DataFrame, roster: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): the counts of a file, in order, given to the documents of its roster."""
    rows = roster.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    return lengths.join(rows.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def unterminated(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(file, n_tokens) of the ids after the last separator of each file that has some."""
    placed = stitch(materialise(scan_blocks(blocks, separator), "separator-scan"))
    total = placed.groupBy("file").agg((F.max(F.col("base") + F.col("n_ids")) - 1 - F.coalesce(F.max("ended"), F.lit(-1))).alias("n_tokens"))
    return total.where("n_tokens > 0")
