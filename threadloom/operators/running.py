"""Running aggregates over a total order, without one task that holds all rows.

Rows are dealt into ranges of the order's first key; each range runs by itself, and a table of one row per range carries
what the ranges before it add. Ranges come from approximate quantiles, but results don't depend on where they are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at least, rows a range should have at most, and ranges at most: cut points go into the plan as a list.
RANGES, RANGE_ROWS, MOST_RANGES, PART = 32, 1_000_000, 4096, 64


def range_count(df: DataFrame) -> int:
    return min(MOST_RANGES, max(RANGES, -(-df.count() // RANGE_ROWS)))


def cut_points(df: DataFrame, key: str, ranges: int) -> list[float]:
    """At most ``ranges`` - 1 distinct values of a numeric key."""
    found = df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    return sorted(set(found))


def _place(key: str, cuts: list[float]) -> Column:
    """A number that grows with the key and is the same between two cuts, from 1; by halves of the list, so many cuts cost few comparisons."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(F.col(key) <= cuts[middle], within(low, middle)).otherwise(within(middle + 1, high))

    if len(cuts) <= PART:
        return within(0, len(cuts))
    # two levels: a long list first by its own cut points, then by a search in the part, kept short for the code that Spark generates
    parts = [cuts[k : k + PART] for k in range(0, len(cuts), PART)]
    ends = F.array(*[F.lit(float(p[-1])) for p in parts])
    table = F.array(*[F.array(*[F.lit(float(c)) for c in p]) for p in parts])
    outer = F.size(F.filter(ends, lambda c: c < F.col(key)))
    inner = F.size(F.filter(F.coalesce(F.get(table, outer), F.array().cast("array<double>")), lambda c: c < F.col(key)))
    return outer * PART + inner + 1


def running(df: DataFrame, key: str, order: list[Column], values: dict[str, tuple[str, Column]], descending: bool = False, partition: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """df with a column per entry of values: the running 'sum', 'max' or 'min' of its expression, current row included.

    ``key`` is the numeric column that ``order`` starts with (nulls last in either direction); ties follow the rest of ``order``. With
    ``partition`` the order is within those columns, and a large partition is still many ranges. The number of ranges is counted from
    the rows unless given; rows of one key stay in one range, so keys that many rows share should be aggregated first.
    """
    partition = partition or []
    cuts = cut_points(df, key, ranges or range_count(df))
    place = F.when(F.col(key).isNull(), len(cuts) + PART + 2).otherwise(_place(key, cuts)).cast("int")
    rows = df.withColumn("_range", F.when(F.col(key).isNull(), place).otherwise(-place) if descending else place)
    inner = Window.partitionBy(*partition, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    totals = rows.groupBy(*partition, "_range").agg(*[fold[f](x).alias(f"_{n}") for n, (f, x) in values.items()])
    # at most ranges + 2 rows for each partition
    outer = Window.partitionBy(*partition, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(p).alias(f"_p{k}") for k, p in enumerate(partition)], F.col("_range").alias("_r"), *[fold[f](f"_{n}").over(outer).alias(f"_{n}") for n, (f, _) in values.items()])
    match = F.col("_range") == F.col("_r")
    for k, p in enumerate(partition):
        match = match & F.col(p).eqNullSafe(F.col(f"_p{k}"))
    local = rows.select("*", *[fold[f](x).over(inner).alias(n) for n, (f, x) in values.items()])
    out = local.join(carried if partition else F.broadcast(carried), match, "left")
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}
    keep = [F.col(c) for c in df.columns]
    return out.select(*keep, *[join[f](F.col(n), F.col(f"_{n}")).alias(n) for n, (f, _) in values.items()])
