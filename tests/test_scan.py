"""Scans over ranges against one pass over each stream, with ranges from one index value to all of them."""

import random

import pytest
from pyspark.sql import functions as F

from lumaframe.operators import scan, sequence
from lumaframe.sources import traces

SCHEMA = "s string, i long, lsb long, idr boolean, ref boolean, delta int, value long"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None, "c"):
        at = rng.sample(range(-40, 400), 60 if s != "c" else 1)
        rows += [(s, i, rng.randrange(16), rng.choice([True, None, False, False, False, False]), rng.choice([True, False, None]), rng.randrange(-60, 60), rng.choice([None, None, rng.randrange(9)])) for i in at]
    rng.shuffle(rows)
    return rows


def plainly(rows, size):
    """gop, full_poc with and without resets, qp, last value and references of each (s, i)."""
    out = {}
    for s in {r[0] for r in rows}:
        gop, last, high, high_reset, qp, held, refs = 0, None, 0, 0, 26, None, []
        for n, (_, i, lsb, idr, ref, delta, value) in enumerate(sorted(r for r in rows if r[0] == s)):
            gop += bool(idr or n == 0)
            step = 0 if last is None else 1 if last - lsb >= 8 else -1 if lsb - last > 8 else 0
            high, high_reset = high + step, 0 if idr else high_reset + step
            qp, held, last = (qp + delta) % 52, value if value is not None else held, lsb
            out[s, i] = (gop, 16 * high + lsb, 16 * high_reset + lsb, qp, held, refs[-size:])
            refs = [*refs, i] if ref else refs
    return out


@pytest.mark.parametrize("seed, width", [(1, 1), (2, 3), (3, 17), (4, 64), (5, 1 << 16)])
def test_ranges_give_what_one_pass_gives(spark, seed, width):
    rows = made(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = sequence.assign_gop(frame, "s", "i", F.col("idr"), width)
    out = sequence.unwrap_poc(out, "s", "i", F.col("lsb"), 16, width=width).withColumnRenamed("full_poc", "p")
    out = sequence.unwrap_poc(out, "s", "i", F.col("lsb"), 16, F.col("idr"), width)
    out = sequence.track_qp(out, "s", "i", 26, F.col("delta"), width=width)
    out = sequence.resolve_parameters(out, "s", "i", F.col("value").isNotNull(), F.col("value"), "held", width)
    out = sequence.reference_window(out, "s", "i", F.col("ref"), 3, width)
    assert out.columns == [*frame.columns, "gop", "p", "full_poc", "qp", "held", "refs"]
    got = {(r.s, r.i): (r.gop, r.p, r.full_poc, r.qp, r.held, r.refs) for r in out.collect()}
    assert got == plainly(rows, 3)


def test_no_window_over_rows_is_partitioned_by_the_stream_alone(spark):
    frame = spark.createDataFrame(made(6), SCHEMA)
    for out in (
        sequence.assign_gop(frame, "s", "i", F.col("idr")), sequence.unwrap_poc(frame, "s", "i", F.col("lsb"), 16, F.col("idr")), sequence.track_qp(frame, "s", "i", 26, F.col("delta")),
        sequence.resolve_parameters(frame, "s", "i", F.col("value") > 0, F.col("value"), "held"), sequence.reference_window(frame, "s", "i", F.col("ref"), 3),
    ):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert any("[_range#" in line for line in windows) and not any("[s#" in line for line in windows)  # windows over summaries have keys of their own


def test_running_sums_of_odd_rows(spark):
    rows = [("a", 0, None), ("a", 5, 2), ("a", 9, None), (None, 1, 1), (None, 2, 1), ("b", None, 7)]
    frame = spark.createDataFrame(rows, "s string, i long, v int")
    got = {(r.s, r.i): r.total for r in scan.running_sum(frame, ["s"], "i", F.col("v"), "total", 4).collect()}
    assert got == {("a", 0): None, ("a", 5): 2, ("a", 9): 2, (None, 1): 1, (None, 2): 2, ("b", None): 7}
    assert scan.running_last(frame.limit(0), ["s"], "i", F.col("v"), "x").count() == 0


def test_headers_are_carried_over_ranges_of_lines(spark):
    lines = [("f", n, f"head={n}" if n % 7 == 3 else "row") for n in range(40)] + [("g", 0, "row"), ("g", 9, "other=4")]
    frame = spark.createDataFrame(lines, "file string, line_no long, line string")
    got = {(r.file, r.line_no): (r.head, r.other) for r in traces.with_headers(frame, {"head": r"^head=(\d+)", "other": r"other=(\d+)"}, width=4).collect()}
    assert got == {**{("f", n): ((n - 3) // 7 * 7 + 3 if n >= 3 else None, None) for n in range(40)}, ("g", 0): (None, None), ("g", 9): (None, 4)}
