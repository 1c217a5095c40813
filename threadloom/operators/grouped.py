"""Sequential work on groups of rows, a group at a time, streamed from sorted partitions: no frame and no call into Spark per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 10_000  # rows that a result batch has before it goes out


def per_group(df: DataFrame, key: list[str], order: list[str], work: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """work(rows of a group as dicts, in order) -> rows of ``schema``, for every group of ``key``. What a task holds is a group."""
    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, now, out = to_arrow_schema(kind), [], None, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in enumerate(zip(*out, strict=True))], names=names)

        for part in batches:
            for row in part.to_pylist():
                own = [row[k] for k in key]
                if held and own != now:
                    out += work(held)
                    held = []
                    if len(out) >= ROWS:
                        yield batch()
                        out = []
                now = own
                held.append(row)
        if held:
            out += work(held)
        if out:
            yield batch()

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, kind)
