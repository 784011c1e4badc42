"""Comparison and quality analytics over planes and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(sse: Column, samples: Column, exact: Column | float = float("inf")) -> Column:
    """10 log10(255^2 n / sse); ``exact`` where nothing differs."""
    return F.when(sse > 0, 10 * F.log10(F.lit(65025.0) * samples / sse)).otherwise(F.lit(exact))


def plane_quality(pairs: DataFrame, keys: list[str], a: Column, b: Column, cap: float | None = None) -> DataFrame:
    """keys, samples, sse, differing, max_diff, mean_a, mean_b and psnr of paired samples. ``cap``: the psnr of an exact match."""
    diff = (a - b).cast("double")
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("samples"), F.sum(diff * diff).alias("sse"), F.sum((diff != 0).cast("long")).alias("differing"), F.max(F.abs(diff)).alias("max_diff"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return sums.withColumn("psnr", psnr(F.col("sse"), F.col("samples"), float("inf") if cap is None else cap))


def first_difference(pairs: DataFrame, keys: list[str], order: list[str], differs: Column) -> DataFrame:
    """The first differing place of each key in the given order, by a partial minimum instead of a sort."""
    return pairs.where(differs).groupBy(*keys).agg(F.min(F.struct(*order)).alias("first")).select(*keys, "first.*")


def trace_diff(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, status (equal, differs, missing_left, missing_right) and n_differing fields of a full outer join."""
    a = left.select(*keys, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_in_a"))
    b = right.select(*keys, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_in_b"))
    both = a.join(b, keys, "full")
    n = sum((F.when(F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), 0).otherwise(1) for f in fields[1:]), F.when(F.col(f"_a_{fields[0]}").eqNullSafe(F.col(f"_b_{fields[0]}")), 0).otherwise(1))
    status = F.when(F.col("_in_a").isNull(), "missing_left").when(F.col("_in_b").isNull(), "missing_right").when(n > 0, "differs").otherwise("equal")
    return both.select(*keys, status.alias("status"), F.when(status == "differs", n).otherwise(0).cast("long").alias("n_differing"))


def first_divergence(left: DataFrame, right: DataFrame, stream: str, order: str, fields: list[str]) -> DataFrame:
    """stream and place of the first row, counted from 1, at which two ordered traces differ or one has ended."""
    w = Window.partitionBy(stream).orderBy(order)
    a, b = (d.withColumn("place", F.row_number().over(w).cast("long")) for d in (left, right))
    return trace_diff(a, b, [stream, "place"], fields).where("status != 'equal'").groupBy(stream).agg(F.min("place").alias("place"))


def type_string(rows: DataFrame, keys: list[str], order: str, kind: str) -> DataFrame:
    """The types of a key in order, as one string."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind])
    return rows.groupBy(*keys).agg(F.array_join(listed, "").alias("types"))


def type_histogram(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """n, the rows of each type of a key."""
    return rows.groupBy(*keys, kind).agg(F.count("*").alias("n"))


def classify_delta(prediction: Column, residual: Column, modes_differ: Column) -> Column:
    """What an error comes from: mode where the modes differ, else the delta of more than twice the other, else mixed."""
    p, r = F.abs(prediction), F.abs(residual)
    return F.when(modes_differ, "mode").when(p > 2 * r, "prediction").when(r > 2 * p, "residual").otherwise("mixed")


def top_by_class(rows: DataFrame, kind: str, size: Column, tie: str, k: int) -> DataFrame:
    """The k largest of each class; ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy(kind).orderBy(size.desc(), tie))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= k)
