"""Trace rows by label, exported vectors, and comparators on hand-made traces."""

from lumaframe.functions import scalar, syntax
from lumaframe.operators import comparators, sequence
from lumaframe.sources import traces
from pyspark.sql import functions as F


def _lines(spark, *lines):
    return spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "file string, line_no long, line string")


def test_labelled_rows(spark):
    lines = _lines(spark, "XCOL mb=7 i8=2 colref0=0 colmv={1,-4} zero=true ref0=0 ref1=-1", "XCOLS mb=8", "note XCOL mb=9 colmv={ 0, 2 }")
    rows = traces.labelled_rows(lines, "XCOL", "colocated").orderBy("line_no").collect()
    assert [(r.mb, r.i8, r.colmv, r.zero, r.ref1) for r in rows] == [(7, 2, [1, -4], 1, -1), (9, None, [0, 2], None, None)]
    (r,) = traces.labelled_rows(_lines(spark, "MODES mb=3 x=1 y=0 8x8=false i4mode=[1 2 -1] i4final=[0,5]"), "MODES", "modes").collect()
    assert (r.mb, r.i4mode, r.i4final, r.i4pred) == (3, [1, 2, -1], [0, 5], None)
    (r,) = traces.labelled_rows(_lines(spark, "ST mb=1 frame=2 kind=skip low=5 range=9"), "ST", "state").collect()
    assert (r.kind, r.low, r.range, r.poc) == ("skip", 5, 9, None)


def test_motion_blocks(spark):
    lines = _lines(spark, "frame=3 type=P", "mv dst=(24,8) size=16x16 src=(1,1) motion=(-4,8)/4", "mv dst=(4,8) size=8x8 src=(1,1) motion=(1,0)/4", "mv dst=(-30,8) size=8x8 src=(1,1) motion=(1,0)/4", "mv dst=(40,40) size=8x8 src=(1,1) motion=(1,0)/0")
    rows = traces.motion_blocks(lines).orderBy("line_no").collect()
    assert [(r.frame, r.mb_x, r.mb_y, r.w, r.h, r.mvx, r.mvy) for r in rows] == [(3, 1, 0, 16, 16, -4, 8), (3, 0, 0, 8, 8, 1, 0)]


def test_representative_block_stays_ambiguous(spark):
    rows = [(1, 1, 8, 8, 0, 0), (1, 2, 8, 8, 1, 0), (1, 3, 16, 16, 5, 5), (2, 1, 16, 8, 3, 3), (2, 2, 8, 16, 3, 3), (3, 1, 8, 8, 2, 2), (3, 2, 8, 8, 2, 2)]
    out = comparators.representative_block(spark.createDataFrame(rows, "k long, line long, w long, h long, mvx long, mvy long"), ["k"], "line", "w", "h", ["mvx", "mvy"])
    assert sorted((r.k, r.w, r.mvx, r.ambiguous, r.area_sum, len(r.candidates)) for r in out.collect()) == [(1, 16, 5, True, 384, 3), (2, 16, 3, True, 256, 2), (3, 8, 2, False, 128, 2)]


def test_reference_lists(spark):
    rows = [("s", i, n, p, r) for i, (n, p, r) in enumerate([(0, 0, True), (1, 8, True), (2, 4, True), (3, 2, False), (3, 6, False)])]
    pictures = spark.createDataFrame(rows, "s string, i long, n long, p long, r boolean")
    found = {(r.i, r.list): [] for r in sequence.reference_lists_b(pictures, "s", "i", "n", "p", F.col("r"), 3).orderBy("i", "list", "place").collect()}
    for r in sequence.reference_lists_b(pictures, "s", "i", "n", "p", F.col("r"), 3).orderBy("i", "list", "place").collect():
        found[r.i, r.list].append(r.ref)
    assert found[3, 0] == [0] and found[3, 1] == [2, 1, 0]  # orders 4 and 8 ahead, then what is behind
    assert found[4, 0] == [2, 0] and found[4, 1] == [1, 2, 0]
    held = sequence.reference_window(pictures.union(pictures.where("i = 4")), "s", "i", F.col("r"), 2)
    assert held.count() == 6 and held.where("i = 4").select("refs").distinct().collect()[0].refs == [1, 2]


def test_motion_boundary_allows_swapped_lists(spark):
    row = spark.createDataFrame([(0, 4, 4, 1, 9, 9)], "r0 int, x0 int, y0 int, r1 int, x1 int, y1 int")
    a = [(F.col("r0"), F.col("x0"), F.col("y0")), (F.col("r1"), F.col("x1"), F.col("y1"))]
    both = row.select(scalar.motion_boundary(a, a[::-1], F.lit(True)).alias("swapped"), scalar.motion_boundary(a, a[::-1], F.lit(False)).alias("plain")).first()
    assert (both.swapped, both.plain) == (False, True)


def test_block_places():
    assert [syntax.block_place(i) for i in (0, 1, 2, 3, 4, 9, 15)] == [(0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 1), (3, 3)]
    assert sorted(syntax.CBP_INTRA) == sorted(syntax.CBP_INTER) == list(range(48))


def test_raw_partition_rows(spark):
    text = ["BPART mb=7 frame=2 poc=4 part=1 list=0 amvd={3,-4} mvd_abs={1,1} mvd={-1,2} ctx pre=123/400 post=99/380", "BPART mb=7 part=1 list=0 amvd={3,-4} mvd={-1,2} pre=1/2 post=3/4", "OTHER mb=7"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no long, line string")
    rows = traces.labelled_rows(lines, "BPART", "raw_partition").orderBy("line_no").collect()
    assert [(r.mb, r.frame, r.poc, r.part, r.list, r.amvd, r.mvd, r.pre_low, r.pre_range, r.post_low, r.post_range) for r in rows] == [(7, 2, 4, 1, 0, [3, -4], [-1, 2], 123, 400, 99, 380), (7, None, None, 1, 0, [3, -4], [-1, 2], 1, 2, 3, 4)]


def test_raw_partition_filters(spark):
    def side(rows):
        return spark.createDataFrame([(mb, line, poc, [a, 0], 1, 300, [0, 0], 2, 301) for mb, line, poc, a in rows], "mb long, line_no long, poc long, amvd array<long>, pre_low long, pre_range long, mvd array<long>, post_low long, post_range long")

    left = side([(1, 0, 8, 5), (1, 1, 8, 6), (1, 2, 10, 7), (2, 3, None, 5), (3, 4, 8, 5)])
    right = side([(1, 0, 8, 6), (3, 2, 8, 9)])
    found = {r.mb: (r.status, r.fields) for r in comparators.raw_partition_diff(left, right, ["mb"], "line_no", occurrences=(1, 0), pocs=(8, None)).collect()}
    assert found == {1: ("equal", "")}
    found = {r.mb: (r.status, r.fields) for r in comparators.raw_partition_diff(left, right, ["mb"], "line_no", pocs=(8, 8)).collect()}
    assert found == {1: ("differs", "amvd"), 3: ("differs", "amvd")}


def test_spatial_buckets_of_all_and_of_the_largest(spark):
    rows = spark.createDataFrame([(0, 0, 3, 9), (1, 3, 3, -9), (2, 4, 0, 1), (3, 8, 7, 0), (4, None, 2, 5)], "line int, x int, y int, delta int")
    found = comparators.spatial_buckets(rows, "x", "y").collect()
    assert {(r.bx, r.b_y): r.n for r in found} == {(0, 0): 2, (1, 0): 1, (2, 1): 1, (None, 0): 1}
    assert {(r.mean_x, r.mean_y) for r in found} == {(3.75, 3.0)}
    found = comparators.spatial_buckets(comparators.largest(rows, "delta", ["line"], 2), "x", "y").collect()
    assert [(r.bx, r.b_y, r.n, r.mean_x, r.mean_y) for r in found] == [(0, 0, 2, 1.5, 3.0)]
    assert comparators.spatial_buckets(rows.limit(0), "x", "y").collect() == []
