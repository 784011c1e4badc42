"""Running values over streams of any length: ranges of the index, what each hands on, then each range by itself.

Rows are dealt by (stream, range of the index), so one long stream is spread
over all tasks. A range's summary is one row; summaries are scanned over the
ranges of their stream, and what comes out is joined back to the range's rows,
where windows finish the work. The rows meet one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Index values in a range: at most so many rows where an index is unique in its stream.
WIDTH = 1 << 16
RANGE = "_range"


def in_ranges(rows: DataFrame, keys: list[str], index: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with the stream and range of each one's index, a whole number, as one column.

    As a struct, keys that are null are equal, and windows, sums and joins on it
    share one shuffle. Rows without index are a range before all others.
    """
    return rows.withColumn(RANGE, F.struct(*keys, F.floor(F.col(index) / width).alias("_n")))


def inside(index: str) -> WindowSpec:
    """Rows of one range in order."""
    return Window.partitionBy(RANGE).orderBy(index)


def along(keys: list[str]) -> WindowSpec:
    """Summaries of a stream in order of their ranges."""
    return Window.partitionBy(*[F.col(f"{RANGE}.{k}") for k in keys]).orderBy(F.col(f"{RANGE}._n"))


def upto(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def carry(rows: DataFrame, keys: list[str], summary: list[Column], over: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """``rows`` beside what the ranges before theirs hand on.

    ``summary`` are aggregates of one range; ``over`` makes the carried columns
    of them, given the window that orders the summaries of a stream.
    """
    summaries = rows.groupBy(RANGE).agg(*summary)
    return rows.join(summaries.select(RANGE, *over(along(keys))), RANGE)


def running_sum(rows: DataFrame, keys: list[str], index: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """name: the sum of ``value`` from the stream's first row to each row; null before the first value."""
    step = in_ranges(rows.withColumn("_value", value), keys, index, width)
    step = carry(step, keys, [F.sum("_value").alias("_sum")], lambda w: [F.sum("_sum").over(before(w)).alias("_before")])
    here = F.sum("_value").over(upto(inside(index)))
    total = F.when(here.isNotNull() | F.col("_before").isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return step.withColumn(name, total).drop("_value", "_before", RANGE)


def running_last(rows: DataFrame, keys: list[str], index: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """name: the last ``value`` that is not null, at or before each row."""
    step = in_ranges(rows.withColumn("_value", value), keys, index, width)
    # The largest index with a value, by a partial maximum: nothing is sorted for it.
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(index)))
    step = carry(step, keys, [latest.alias("_last")], lambda w: [F.last("_last", ignorenulls=True).over(before(w)).alias("_before")])
    here = F.last("_value", ignorenulls=True).over(upto(inside(index)))
    return step.withColumn(name, F.coalesce(here, "_before")).drop("_value", "_before", RANGE)
