"""Scalar video arithmetic as Column expressions. Integers are computed wide and wrapped explicitly where the format wraps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chroma quantiser by clipped luma quantiser 0..51 (identity below 30).
CHROMA_QP = [*range(30), 29, 30, 31, 32, 32, 33, 34, 34, 35, 35, 36, 36, 37, 37, 37, 38, 38, 38, 39, 39, 39, 39]


def clip3(lo: Column | int, hi: Column | int, x: Column) -> Column:
    lo, hi = (F.lit(v) if isinstance(v, int) else v for v in (lo, hi))
    return F.greatest(lo, F.least(hi, x))


def wrap16(x: Column) -> Column:
    """The value as a 16-bit signed integer holds it."""
    return F.pmod(x.cast("long") + 32768, F.lit(65536)) - 32768


def median3(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def ue_length(v: Column) -> Column:
    """Bits of the unsigned exp-Golomb code of v."""
    return 2 * F.length(F.bin(v.cast("long") + 1)).cast("long") - 1


def se_value(code: Column) -> Column:
    """Signed exp-Golomb: 1, 2, 3, 4 stand for 1, -1, 2, -2."""
    code = code.cast("long")
    return F.when(code % 2 == 0, -F.floor(code / 2)).otherwise(F.floor((code + 1) / 2))


def te_value(code: Column, most: Column) -> Column:
    """Truncated exp-Golomb: one inverted bit where the range is 0..1, else clamped."""
    return F.when(most == 1, F.lit(1) - F.least(code, F.lit(1))).otherwise(F.least(code, most))


def chroma_qp(qp: Column, offset: Column | int) -> Column:
    at = clip3(0, 51, (qp + offset).cast("int"))
    return F.element_at(F.array(*map(F.lit, CHROMA_QP)), at + 1)


def distance_scale(current: Column, before: Column, after: Column) -> Column:
    """The share of 256 that the way to ``current`` has of the way to ``after``, in picture orders; null without a distance."""
    tb, td = clip3(-128, 127, current - before), clip3(-128, 127, after - before)
    whole = lambda x: x.cast("long")  # noqa: E731  casts truncate toward zero
    tx = whole((16384 + F.abs(whole(td / 2))) / F.nullif(td, F.lit(0)))
    # least and greatest pass over nulls, so a missing distance is put back.
    return F.when(td != 0, clip3(-1024, 1023, F.shiftright(tb.cast("long") * tx + 32, 6)))


def temporal_vector(mv: Column, scale: Column) -> Column:
    """One component of a colocated vector scaled by 256ths, rounded."""
    return F.shiftright(mv * F.coalesce(scale, F.lit(256)) + 128, 8)


def implicit_weight(current: Column, before: Column, after: Column) -> Column:
    """The second reference's weight of 64 in implicit bi-prediction from picture orders; 32 outside the legal range."""
    weight = F.shiftright(distance_scale(current, before, after), 2)
    return F.coalesce(F.when((weight >= -64) & (weight <= 128), weight), F.lit(32)).cast("long")


def bi_blend(a: Column, b: Column, w1: Column) -> Column:
    """Weighted mean of two samples, w1 of 64 on the second, rounded and clipped; the plain mean at 32."""
    return F.when(w1 == 32, F.shiftright(a + b + 1, 1)).otherwise(clip3(0, 255, F.shiftright(a * (64 - w1) + b * w1 + 32, 6)))


def weighted_sample(x: Column, weight: Column, offset: Column, denominator: int) -> Column:
    """Explicit weighting of one sample: scaled by weight / 2^denominator, rounded, shifted and clipped."""
    scaled = F.shiftright(x * weight + (1 << (denominator - 1)), denominator) if denominator else x * weight
    return clip3(0, 255, scaled + offset)


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    """Full-range BT.601 in integers with ten fraction bits."""
    cb, cr = u - 128, v - 128
    part = lambda x: clip3(0, 255, x)
    return F.struct(part(y + F.shiftright(cr * 1436, 10)).alias("r"), part(y - F.shiftright(cb * 352 + cr * 731, 10)).alias("g"), part(y + F.shiftright(cb * 1814, 10)).alias("b"))


def boundary_strength(intra: Column, mb_edge: Column, coefficients: Column, moved: Column) -> Column:
    """Deblocking strength 0..4 of an edge."""
    return F.when(intra & mb_edge, 4).when(intra, 3).when(coefficients, 2).when(moved, 1).otherwise(0).cast("long")


def moves_apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Quarter-sample vectors that differ by a whole sample or more in either direction."""
    return (F.abs(ax - bx) >= 4) | (F.abs(ay - by) >= 4)


def _same_motion(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """(reference, x, y) of both: one reference and, unless there is none, vectors less than a whole sample apart."""
    return (a[0] == b[0]) & ((a[0] < 0) | ~moves_apart(a[1], a[2], b[1], b[2]))


def motion_boundary(a: list[tuple], b: list[tuple], bidirectional: Column) -> Column:
    """Whether motion differs at an edge. a and b: (reference, x, y) for list 0 and list 1; B blocks may match with their lists swapped."""
    straight, swapped = (_same_motion(a[0], b[i]) & _same_motion(a[1], b[1 - i]) for i in (0, 1))
    return F.when(bidirectional, ~(straight | swapped)).otherwise(~_same_motion(a[0], b[0]))


def order_key(full_poc: Column, poc: Column) -> Column:
    """The picture order to sort by: the unwrapped one, or the plain one where that was never set."""
    return F.when((full_poc != 0) | (poc == 0), full_poc).otherwise(poc)


def slice_group_bits(wide: Column, high: Column, rate: Column) -> Column:
    """Bits of a slice header's group change cycle: those that count the macroblocks of a picture in steps of ``rate``; none without a rate or a picture, or with more macroblocks than 32 bits hold."""
    size = wide.cast("long") * high.cast("long")
    steps = F.when((rate > 0) & (size > 0) & (size < 1 << 32), F.floor(size / F.when(rate > 0, rate))).otherwise(0).cast("long")
    return F.when(steps > 0, F.length(F.bin(steps))).otherwise(0)
