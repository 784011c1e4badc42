"""Neighbour rules: vectors predicted from a table against a macroblock-by-macroblock loop, and edges read in any batches."""

import random

import pytest
from pyspark.sql import functions as F

from lumaframe.functions import deblock
from lumaframe.operators.neighbours import SHAPES, predict_vectors, predicted_modes, spatial_direct


def coded_pictures(seed, wide=5, high=4):
    """Macroblocks in coding order: differences are drawn, vectors follow from what lies before them."""
    rng = random.Random(seed)
    rows, differences = [], {}
    for pic in range(3):
        seen = {}  # (cx, cy) -> (ref, x, y)
        for mb in range(wide * high):
            mx, my = mb % wide, mb // wide
            if rng.random() < 0.08:  # a lost macroblock
                continue
            shape = rng.choice(["16x16", "16x8", "8x16", "8x8", "skip", "intra"])
            if shape == "intra":
                for k in range(16):
                    seen[4 * mx + k % 4, 4 * my + k // 4] = (-1, 0, 0)
            for part, (px, py, w, h) in enumerate(SHAPES.get(shape, [])):
                cx, cy, ref = 4 * mx + px, 4 * my + py, 0 if shape == "skip" else rng.randrange(3)
                right = 4 * mx + 4
                at = lambda x, y: seen.get((x, y), (-2, 0, 0)) if not (x >= right and y >= 4 * my) else (-2, 0, 0)  # noqa: B023, E731
                a, b, c, d = at(cx - 1, cy), at(cx, cy - 1), at(cx + w, cy - 1), at(cx - 1, cy - 1)
                c = d if c[0] == -2 else c
                same = [n for n in (a, b, c) if n[0] == ref]
                if shape == "skip" and (a[0] == -2 or b[0] == -2 or (0, 0, 0) in (a, b)):
                    pred = (0, 0)
                elif (shape, part) in (("16x8", 0), ("8x16", 1)) and (n := b if shape == "16x8" else c)[0] == ref:
                    pred = n[1:]
                elif (shape, part) in (("16x8", 1), ("8x16", 0)) and a[0] == ref:
                    pred = a[1:]
                elif len(same) == 1:
                    pred = same[0][1:]
                elif not same and b[0] == c[0] == -2 != a[0]:
                    pred = a[1:]
                else:
                    pred = tuple(sorted(v)[1] for v in zip(a[1:], b[1:], c[1:], strict=True))
                diff = (0, 0) if shape == "skip" else (rng.choice([0, 0, 1, -7, 30000]), rng.choice([0, 3, -30000]))
                vector = tuple((p + e + 32768) % 65536 - 32768 for p, e in zip(pred, diff, strict=True))
                differences[pic, mx, my, part] = (ref, *pred, *diff)
                for y in range(cy, cy + h):
                    for x in range(cx, cx + w):
                        seen[x, y] = (ref, *vector)
            cells = [seen[4 * mx + k % 4, 4 * my + k // 4] for k in range(16)]
            rows.append(("s", pic, mx, my, shape, *[[c[n] for c in cells] for n in range(3)]))
    rng.shuffle(rows)
    return rows, differences


@pytest.mark.parametrize("seed", [1, 2])
def test_prediction_plus_difference_is_the_vector(spark, seed):
    rows, want = coded_pictures(seed)
    frame = spark.createDataFrame(rows, "stream string, pic int, mb_x int, mb_y int, shape string, ref array<int>, x array<int>, y array<int>").repartition(5)
    found = predict_vectors(frame, ["stream", "pic"]).collect()
    got = {(r.pic, r.mb_x, r.mb_y, r.part): (r.ref, r.pred_x, r.pred_y, r.diff_x, r.diff_y) for r in found}
    assert got == want and len(found) == len(want)


def test_edges_do_not_depend_on_batches(spark):
    rng = random.Random(3)
    each = lambda lo, hi: [rng.randrange(lo, hi) for _ in range(16)]
    rows = [(s, p, x, y, rng.random() < 0.2, rng.random() < 0.5, rng.random() < 0.3, each(0, 2), each(-1, 2), each(-1, 2), each(0, 6), each(0, 6), each(0, 6), each(0, 6)) for s in ("a", None) for p in range(3) for x in range(6) for y in range(5) if rng.random() < 0.9]
    frame = spark.createDataFrame(rows, "s string, p int, mb_x int, mb_y int, intra boolean, is_b boolean, transform_8x8 boolean, " + ", ".join(f"{n} array<int>" for n in ("nz", "ref0", "ref1", "x0", "y0", "x1", "y1")))
    listed = lambda: sorted(map(str, deblock.edge_strengths(frame, ["s", "p"]).collect()))
    want = listed()
    assert len(want) == 8 * len(rows)
    try:
        for size in ("1", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert listed() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Against each edge by itself.
    by_place = {r[:4]: r for r in rows}
    for text in deblock.edge_strengths(frame, ["s", "p"]).where("direction = 'h' AND edge = 0").collect():
        here, there = by_place[text.s, text.p, text.mb_x, text.mb_y], by_place.get((text.s, text.p, text.mb_x, text.mb_y - 1))
        if here[4] or there and there[4]:
            assert text.bs == [4] * 4
        elif there is None:
            assert text.bs == [0] * 4
        else:
            for k in range(4):
                one = lambda r, i, at: (r[8 + i][at], r[10 + 2 * i][at], r[11 + 2 * i][at])
                alike = lambda i, j: (a := one(here, i, k))[0] == (b := one(there, j, 12 + k))[0] and (a[0] < 0 or abs(a[1] - b[1]) < 4 and abs(a[2] - b[2]) < 4)  # noqa: B023, E731
                same = alike(0, 0) and alike(1, 1) or alike(0, 1) and alike(1, 0) if here[5] or there[5] else alike(0, 0)
                assert text.bs[k] == (2 if here[7][k] or there[7][12 + k] else 0 if same else 1)


def test_modes_and_direct_motion_at_the_edges(spark):
    modes = spark.createDataFrame([(1, 0, 0, [3] * 16), (1, 1, 0, [1] * 16), (1, 1, 1, [-1] * 16)], "p int, mb_x int, mb_y int, mode array<int>")
    got = {(r.mb_x, r.mb_y): (r.predicted, r.raw) for r in predicted_modes(modes, ["p"]).collect()}
    assert got[0, 0][0] == [2] * 5 + [3] * 3 + [2] + [3] * 3 + [2] + [3] * 3 and got[1, 0][0][4] == 1 and got[1, 1][0][0] == 2
    assert got[0, 0][1][5] == -1 and got[0, 0][1][0] == 2
    still = [0] * 16
    rows = [(1, 0, 0, 0, True, False, True, [2] * 16, [5] * 16, [1] * 16, [-1] * 16, still, still), (0, 9, 0, 0, False, False, True, still, [1] * 16, still, [-1] * 16, still, still)]
    frame = spark.createDataFrame(rows, "p int, col int, mb_x int, mb_y int, direct boolean, intra boolean, whole boolean, " + ", ".join(f"{n} array<int>" for n in ("ref0", "x0", "y0", "ref1", "x1", "y1")))
    found = spatial_direct(frame, frame, ["p"], ["col"]).orderBy("quarter").collect()
    assert [tuple(r) for r in found] == [(1, 0, 0, q, True, 0, 0, 0, 0, 0, 0) for q in range(4)]
    assert spatial_direct(frame.where(F.col("p") == 1), frame.limit(0), ["p"], ["col"]).where("still").count() == 0


def test_direct_motion_ships_no_arrays_and_reads_its_table_once(spark):
    from lumaframe.plans import registry

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()["spatial_direct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # The table by picture, direct macroblocks by their colocated place, and still quarters; both sides read the first.
    assert plan.count("- Exchange ") == 3 and plan.count("ReusedExchange") == 1


def test_direct_motion_of_nulls_and_gaps(spark):
    """Rows without a picture or a place have no neighbours, even if alike; others look past gaps for nothing."""
    one = lambda p, x, y, v: (p, 9, x, y, True, False, [v] * 16, [v * 3] * 16, [v * 5] * 16, [-1] * 16, [0] * 16, [0] * 16)
    rows = [one(None, 0, 0, 1), one(None, 1, 0, 2), one(1, None, 0, 1), one(1, None, 0, 2), one(1, -1, -2, 4), one(1, 0, -2, 5), one(1, 2, -2, 3), one(1, 0, -1, 6), one(1, 1, -1, 7), one(1, 3, -1, 8)]
    frame = spark.createDataFrame(rows, "p int, col int, mb_x int, mb_y int, direct boolean, intra boolean, " + ", ".join(f"{n} array<int>" for n in ("ref0", "x0", "y0", "ref1", "x1", "y1"))).repartition(4)
    found = spatial_direct(frame, frame.where("p = 1"), ["p"], ["col"]).where("quarter = 2").collect()
    got = sorted(((r.p, r.mb_x, r.mb_y, r.ref0, r.x0, r.y0, r.ref1, r.still) for r in found), key=str)
    no = (0, 0, 0, 0, False)
    # (0, -1): above is 5, above left 4; (1, -1): on the left 6, above right 3; (3, -1): above left 3; (0, -2): on the left 4.
    want = [(None, 0, 0, *no), (None, 1, 0, *no), (1, None, 0, *no), (1, None, 0, *no), (1, -1, -2, *no), (1, 0, -2, 4, 12, 20, -1, False), (1, 2, -2, *no), (1, 0, -1, 4, 12, 20, -1, False), (1, 1, -1, 3, 9, 15, -1, False), (1, 3, -1, 3, 9, 15, -1, False)]
    assert got == sorted(want, key=str)
