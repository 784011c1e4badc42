"""Picture-sequence operators as scans over ranges of a stream, windows and joins.

Whatever runs along a whole stream is a scan (see scan.py), so that no task
holds a stream. ``index`` is a whole number that is unique in its stream;
``width`` index values make a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.operators import scan
from lumaframe.operators.scan import RANGE, WIDTH, before, inside, upto


def _order(stream: str, index: str):
    return Window.partitionBy(stream).orderBy(index)


def assign_gop(pictures: DataFrame, stream: str, index: str, is_idr: Column, width: int = WIDTH) -> DataFrame:
    """gop: one more at the first picture and at each IDR picture."""
    step = scan.in_ranges(pictures.withColumn("_idr", F.coalesce(is_idr, F.lit(False)).cast("int")), [stream], index, width)
    summary = [F.sum("_idr").alias("_idrs"), F.min_by("_idr", index).alias("_first")]
    over = lambda w: [F.coalesce(F.sum("_idrs").over(before(w)), F.lit(0)).alias("_before"), F.first("_first").over(upto(w)).alias("_begin")]
    step = scan.carry(step, [stream], summary, over)
    gop = F.col("_before") + F.sum("_idr").over(upto(inside(index))) + 1 - F.col("_begin")
    return step.withColumn("gop", gop).drop("_idr", "_before", "_begin", RANGE)


def display_order(pictures: DataFrame, stream: str, index: str, poc: Column) -> DataFrame:
    """display_rank within the group of pictures: by picture order, decode order among equals."""
    return pictures.withColumn("_poc", poc).withColumn("display_rank", F.row_number().over(Window.partitionBy(stream, "gop").orderBy("_poc", index)).cast("long")).drop("_poc")


def unwrap_poc(pictures: DataFrame, stream: str, index: str, lsb: Column, modulus: int, reset: Column | None = None, width: int = WIDTH) -> DataFrame:
    """full_poc: the picture order with its high part, which steps when the low part jumps by half the modulus or more.

    ``reset`` (IDR pictures) starts again from the low part. A range hands on
    its last low part, its steps, and its steps since its last reset; the step
    at its first picture needs the range before and is added to its summary.
    """
    half = modulus // 2
    resets = F.coalesce(reset, F.lit(False)) if reset is not None else F.lit(False)
    step = scan.in_ranges(pictures.withColumn("_lsb", lsb).withColumn("_reset", resets), [stream], index, width)

    def high_step(now: Column, last: Column, starts: Column) -> Column:
        jump = now - last
        return F.when(starts | last.isNull(), 0).when(-jump >= half, 1).when(jump > half, -1).otherwise(0)

    w = inside(index)
    first = F.row_number().over(w) == 1
    step = step.withColumn("_carry", F.when(first, 0).otherwise(high_step(F.col("_lsb"), F.lag("_lsb").over(w), F.col("_reset"))))
    step = step.withColumn("_sum", F.sum("_carry").over(upto(w))).withColumn("_from", F.last(F.when(F.col("_reset"), F.col("_sum")), ignorenulls=True).over(upto(w)))
    summary = [
        F.min_by("_lsb", index).alias("_first_lsb"), F.min_by("_reset", index).alias("_first_reset"), F.max_by("_lsb", index).alias("_last_lsb"),
        F.max_by("_sum", index).alias("_steps"), F.max_by("_from", index).alias("_reset_at"),
    ]

    # Windows over summaries: the step into each range, then the sums before it.
    w = scan.along([stream])
    summaries = step.groupBy(RANGE).agg(*summary).withColumn("_into", high_step(F.col("_first_lsb"), F.lag("_last_lsb").over(w), F.col("_first_reset")))
    summaries = summaries.withColumn("_before", F.coalesce(F.sum(F.col("_into") + F.col("_steps")).over(before(w)), F.lit(0)) + F.col("_into"))
    base = F.last(F.col("_before") + F.col("_reset_at"), ignorenulls=True).over(before(w))
    step = step.join(summaries.select(RANGE, "_before", F.coalesce(base, F.lit(0)).alias("_base")), RANGE)
    since = F.when(F.col("_from").isNotNull(), F.col("_sum") - F.col("_from")).otherwise(F.col("_before") + F.col("_sum") - F.col("_base"))
    return step.withColumn("full_poc", (since * modulus + F.col("_lsb")).cast("long")).drop("_lsb", "_reset", "_carry", "_sum", "_from", "_before", "_base", RANGE)


def track_qp(units: DataFrame, stream: str, index: str, initial: int, delta: Column, range_: int = 52, width: int = WIDTH) -> DataFrame:
    """qp: the running quantiser, kept in 0..range - 1."""
    summed = scan.running_sum(units, [stream], index, delta.cast("long"), "_total", width)
    return summed.withColumn("qp", F.pmod(F.lit(initial) + F.col("_total"), F.lit(range_)).cast("long")).drop("_total")


def resolve_parameters(units: DataFrame, stream: str, index: str, is_set: Column, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """name: the parameter set in force, the last one before or at each unit of its stream."""
    return scan.running_last(units, [stream], index, F.when(is_set, value), name, width)


def _last_references(rows: DataFrame, keys: list[Column], order: Column, value: Column, size: int, name: str) -> DataFrame:
    """name: ``value`` of the last ``size`` rows with _ref before each row of the same keys, in order of value."""
    # A reference that k others precede is held by the rows that k + 1 to k + size precede: a frame over k, so no row meets another as a row.
    counted = rows.withColumn("_k", F.coalesce(F.sum(F.col("_ref").cast("int")).over(before(Window.partitionBy(*keys).orderBy(order))), F.lit(0)))
    held = Window.partitionBy(*keys).orderBy("_k").rangeBetween(-size, -1)
    return counted.withColumn(name, F.array_sort(F.collect_list(F.when(F.col("_ref"), value)).over(held))).drop("_k")


def reference_window(pictures: DataFrame, stream: str, index: str, is_reference: Column, size: int, width: int = WIDTH) -> DataFrame:
    """refs: the last ``size`` reference pictures before each picture, oldest first. Add the group of pictures to a composed ``stream`` key to start anew in each.

    A range hands on its last ``size`` references; those that reach into a
    later range are found by the same rule over these alone.
    """
    refs = scan.in_ranges(pictures.withColumn("_ref", F.coalesce(is_reference, F.lit(False))), [stream], index, width)
    local = _last_references(refs, [F.col(RANGE)], F.col(index), F.col(index), size, "_near")
    # The last references of a range by a window limit, so that no range hands on more than ``size``; a mark stands before the range's own.
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(F.desc(index)))
    tails = refs.where("_ref").select(RANGE, "_ref", F.col(index).alias("_i"), place.alias("_place")).where(F.col("_place") <= size).drop("_place")
    marks = refs.groupBy(RANGE).agg(F.lit(False).alias("_ref"), F.min(index).alias("_i"))
    order = F.struct(F.col(f"{RANGE}._n"), "_ref", "_i")
    far = _last_references(tails.union(marks), [F.col(f"{RANGE}.{stream}")], order, F.col("_i"), size, "_far").where("not _ref").select(RANGE, "_far")
    every = F.concat("_far", "_near")
    found = F.when(F.size(every) > size, F.slice(every, -size, size)).otherwise(every)
    return local.join(far, RANGE).withColumn("refs", found).drop("_ref", "_near", "_far", RANGE)


def _held(pictures: DataFrame, stream: str, index: str, frame_num: str, poc: str, is_reference: Column, size: int) -> DataFrame:
    """(stream, index, _now, ref, _n, _p): each picture's order beside frame number and order of every reference it may use."""
    held = reference_window(pictures.select(stream, index, F.col(poc).alias("_now"), is_reference.alias("_is_ref")), stream, index, F.col("_is_ref"), size)
    wanted = held.select(stream, index, "_now", F.explode("refs").alias("ref"))
    return wanted.join(pictures.select(stream, F.col(index).alias("ref"), F.col(frame_num).alias("_n"), F.col(poc).alias("_p")), [stream, "ref"])


def reference_lists_b(pictures: DataFrame, stream: str, index: str, frame_num: str, poc: str, is_reference: Column, size: int) -> DataFrame:
    """(stream, index, list, place, ref) over the held references of each picture.

    List 0: those before it in picture order, nearest first. List 1: those
    after it, nearest first, then all others from the latest down; of equal
    orders the highest frame number. What is still equal goes in decode order.
    """
    found = _held(pictures, stream, index, frame_num, poc, is_reference, size)
    away = F.abs(F.col("_p") - F.col("_now"))
    before, after = F.col("_p") < F.col("_now"), F.col("_p") > F.col("_now")
    zero = found.where(before).select(stream, index, "ref", F.lit(0).alias("list"), F.lit(0).alias("_part"), away.alias("_away"), F.lit(0).cast("long").alias("_n"))
    one = found.select(stream, index, "ref", F.lit(1).alias("list"), F.when(after, 0).otherwise(1).alias("_part"), away.alias("_away"), F.col("_n").cast("long").alias("_n"))
    place = F.row_number().over(Window.partitionBy(stream, index, "list").orderBy("_part", "_away", F.desc("_n"), "ref"))
    return zero.union(one).withColumn("place", place).select(stream, index, "list", "place", "ref")


def limit_decoded(pictures: DataFrame, stream: str, index: str, n: int) -> DataFrame:
    """The first ``n`` pictures of each stream in decode order, ahead of any display order."""
    place = F.row_number().over(_order(stream, index))
    return pictures.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def stream_summary(pictures: DataFrame, stream: str, width: str, height: str, is_idr: Column) -> DataFrame:
    """Pictures, IDR pictures and sizes of each stream."""
    return pictures.groupBy(stream).agg(F.count("*").alias("n_pictures"), F.count_if(is_idr).alias("n_idr"), F.max(width).alias("width"), F.max(height).alias("height"))


def expand_skips(rows: DataFrame, run: Column, name: str = "skipped") -> DataFrame:
    """One row for each macroblock that a skip run covers, numbered from 0; rows without a run go."""
    return rows.withColumn("_run", run.cast("long")).where("_run > 0").withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_run") - 1))).drop("_run")


def occurrence(rows: DataFrame, group: list[str], line: str, item: str) -> DataFrame:
    """occurrence: one more whenever ``item`` does not increase inside the group; from 0."""
    w = Window.partitionBy(*group).orderBy(line)
    again = F.when(F.col(item) <= F.lag(item).over(w), 1).otherwise(0)
    return rows.withColumn("_again", again).withColumn("occurrence", F.sum("_again").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_again")


def repeat_number(rows: DataFrame, key: list[str], line: str) -> DataFrame:
    """repeat: how often the key was seen before, in line order."""
    return rows.withColumn("repeat", (F.row_number().over(Window.partitionBy(*key).orderBy(line)) - 1).cast("long"))


def reference_list_p(pictures: DataFrame, stream: str, index: str, frame_num: str, poc: str, is_reference: Column, size: int) -> DataFrame:
    """(stream, index, place, ref): the held references, highest frame number first, then highest picture order.

    Where all have one frame number, the latest comes first. Only the last
    ``size`` references of each picture are joined, so rows grow with the pictures.
    """
    found = _held(pictures, stream, index, frame_num, poc, is_reference, size)
    whole = Window.partitionBy(stream, index)
    one = F.min("_n").over(whole) == F.max("_n").over(whole)
    ranked = found.withColumn("_p", F.when(one, F.col("ref")).otherwise(F.col("_p")))
    place = F.row_number().over(whole.orderBy(F.desc("_n"), F.desc("_p"), F.desc("ref")))
    return ranked.withColumn("place", place).select(stream, index, "place", "ref")
