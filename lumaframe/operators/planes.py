"""Paired planes compared as they are: one row a pair goes in, one row of partial sums comes out.

No sample becomes a row. The partials of parts merge to those of the whole, so
frames, streams or whole corpora are summed by an ordinary aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.operators.compare import psnr

#: Samples handled at once inside a plane.
_STEP = 1 << 20
_PARTIALS = ["samples", "sse", "differing", "max_diff", "sum_a", "sum_b", "first_at", "first_a", "first_b", "same_size"]


def _partials(a: memoryview, b: memoryview) -> tuple:
    """samples, sse, differing, max_diff, sum_a, sum_b, first_at, first_a, first_b and same_size of the samples that both have."""
    n, sse, differing, most, sums, first = min(len(a), len(b)), 0, 0, 0, [0, 0], (None, None, None)
    for at in range(0, n, _STEP):
        x, y = (np.frombuffer(v[at : min(at + _STEP, n)], np.uint8).astype(np.int32) for v in (a, b))
        diff = x - y
        unlike = np.flatnonzero(diff)
        if len(unlike):
            sse += int((diff.astype(np.int64) ** 2).sum())
            most = max(most, int(np.abs(diff).max()))
            differing += len(unlike)
            if first[0] is None:
                first = at + int(unlike[0]), int(x[unlike[0]]), int(y[unlike[0]])
        sums = [sums[0] + int(x.sum(dtype=np.int64)), sums[1] + int(y.sum(dtype=np.int64))]
    return n, sse, differing, most, *sums, *first, len(a) == len(b)


def pair_planes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, a and b: planes of both sides by ``keys``, which name one plane each; null where a side has none.

    Both sides grow, so they meet by a merge join; planes travel once each.
    """
    a = left.select(*keys, F.col("width"), F.col("height"), F.col("data").alias("a"))
    b = right.select(*keys, F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("data").alias("b"))
    joined = a.join(b.hint("merge"), keys, "full")
    return joined.select(*keys, F.coalesce("width", "_w").alias("width"), F.coalesce("height", "_h").alias("height"), "a", "b")


def plane_partials(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys and, for the samples of ``a`` and ``b``: samples, sse, differing, max_diff, sum_a, sum_b, the first differing place with both values, same_size.

    A missing plane counts as one without samples. Planes of unequal sizes are
    compared as far as both go, and same_size is false.
    """
    fields = [pairs.schema[k] for k in keys]
    kinds = [T.LongType()] * 9 + [T.BooleanType()]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in zip(_PARTIALS, kinds, strict=True)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = lambda name, i: memoryview(s.as_buffer() or b"") if (s := batch.column(name)[i]).is_valid else memoryview(b"")  # noqa: B023, E731
            rows = [_partials(view("_a", i), view("_b", i)) for i in range(batch.num_rows)]
            made = list(zip(*rows, strict=True)) or [[] for _ in _PARTIALS]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(c, arrow.field(n).type) for n, c in zip(_PARTIALS, made, strict=True)]], schema=arrow)

    binary = lambda c, name: F.col(c).cast("binary").alias(name)
    return pairs.select(*keys, binary(a, "_a"), binary(b, "_b")).mapInArrow(run, schema)


def merge_partials(partials: DataFrame, keys: list[str], order: list[str] | None = None, cap: float | None = None) -> DataFrame:
    """Partials summed by ``keys``, with means and psnr; ``cap`` is the psnr of an exact match, infinite unless given.

    The first difference is that of the first row in ``order``, its columns
    included; without an order it is left out.
    """
    sums = [F.sum("samples").alias("samples"), F.sum("sse").cast("double").alias("sse"), F.sum("differing").alias("differing"), F.max("max_diff").cast("double").alias("max_diff"), F.sum("sum_a").alias("_a"), F.sum("sum_b").alias("_b"), F.min("same_size").alias("same_size")]
    if order:
        sums.append(F.min(F.when(F.col("first_at").isNotNull(), F.struct(*order, "first_at", "first_a", "first_b"))).alias("first"))
    whole = partials.groupBy(*keys).agg(*sums) if keys else partials.agg(*sums)
    mean = lambda c: F.when(F.col("samples") > 0, F.col(c) / F.col("samples"))
    quality = psnr(F.col("sse"), F.col("samples"), float("inf") if cap is None else cap)
    return whole.select(*keys, "samples", "sse", "differing", "max_diff", mean("_a").alias("mean_a"), mean("_b").alias("mean_b"), quality.alias("psnr"), "same_size", *(["first"] if order else []))


def plane_order(plane: Column) -> Column:
    """Y, U, V as 0, 1, 2: the order in which a frame's first difference is looked for."""
    return F.when(plane == "Y", 0).when(plane == "U", 1).otherwise(2)


def place_in_frame(first_at: Column, width: Column, plane: Column) -> Column:
    """x, y and the macroblock of a raster place in a plane."""
    x, y, span = first_at % width, F.floor(first_at / width), F.when(plane == "Y", 16).otherwise(8)
    return F.struct(x.alias("x"), y.alias("y"), F.floor(x / span).alias("mb_x"), F.floor(y / span).alias("mb_y"))
