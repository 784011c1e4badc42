"""Files read by byte ranges: any cut gives the units and frames of the whole file; paired planes against exploded samples."""

import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.operators import compare, planes
from lumaframe.sources import annexb, frames, ranges
from test_annexb import header, pps, sps, unit


def stream(seed, n=12):
    rng = random.Random(seed)
    out = b"".join(rng.choice([b"\x00\x00\x01", b"\x00\x00\x00\x01", b"\x00\x00\x00\x00\x01"]) + bytes([rng.choice([0x65, 0x41, 0x00])]) + bytes(rng.choice([0, 0, 1, 3, 9]) for _ in range(rng.randrange(9))) for _ in range(n))
    return bytes(rng.choice([0, 1, 7]) for _ in range(rng.randrange(4))) + out


def by_ranges(data, edges, read_bytes):
    found = []
    for start, end in zip(edges, edges[1:], strict=False):
        found += [u for _, u in ranges.units_of_range(io.BytesIO(data), start, end, read_bytes)]
    return [(u[0] >> 5 & 3, u[0] & 31, u[1:]) for u in found]


@pytest.mark.parametrize("seed", range(20))
def test_any_cut_gives_the_same_units(seed):
    data = stream(seed)
    want = annexb.split_units(data)
    for at in range(len(data) + 1):
        assert by_ranges(data, [0, at, len(data)], 1 + seed) == want
    for step in (1, 2, 3, 5, 17):
        assert by_ranges(data, [*range(0, len(data), step), len(data)], 4) == want
    places = [at for at, _ in ranges.units_of_range(io.BytesIO(data), 0, len(data))]
    assert all(data[at : at + 3] == b"\x00\x00\x01" for at in places)


@pytest.mark.parametrize("data", [b"", b"\x00", b"\x00\x00\x01", b"\x00\x00\x00", b"abc", b"\x00\x00\x01\x00\x00", b"\x00\x00\x01\x65"])
def test_streams_of_hardly_anything(data):
    assert by_ranges(data, [0, len(data)], 2) == annexb.split_units(data)


@pytest.mark.parametrize("split_bytes", [7, 40, 1 << 20])
def test_source_equals_the_splitter(spark, tmp_path, split_bytes):
    for n in range(3):
        (tmp_path / f"s{n}.264").write_bytes(stream(100 + n, 60))
    (tmp_path / "empty.264").write_bytes(b"")
    (tmp_path / ".hidden").write_bytes(stream(1))
    want = {tuple(r) for r in annexb.nal_units(annexb.read_streams(spark, f"{tmp_path}/*.264")).collect()}
    got = ranges.read_units(spark, str(tmp_path), split_bytes)
    rows = got.collect()
    assert got.columns == ["stream_id", "nal_idx", "ref_idc", "nal_type", "payload"]
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    placed = ranges.read_units(spark, f"file://{tmp_path}/s1.264", split_bytes, numbered=False).orderBy("nal_idx").collect()
    assert [r.payload for r in placed] == [r.payload for r in sorted(rows, key=lambda r: r.nal_idx) if r.stream_id.endswith("s1.264")]


def test_headers_run_on_ranges_unchanged(spark, tmp_path):
    data = b"".join([unit(7, sps()), unit(8, pps()), unit(5, header()), *[unit(1, header(idr=False, frame=n % 16, poc=n % 16)) for n in range(40)], unit(8, pps(qp=30)), unit(1, header(idr=False))])
    (tmp_path / "s.264").write_bytes(data)
    whole = annexb.slice_headers(annexb.nal_units(annexb.read_streams(spark, str(tmp_path))))
    for numbered in (True, False):
        parts = annexb.slice_headers(ranges.read_units(spark, str(tmp_path), 50, numbered))
        keep = [c for c in whole.columns if c != "nal_idx"]
        assert [r for r in parts.orderBy("nal_idx").select(keep).collect()] == [r for r in whole.orderBy("nal_idx").select(keep).collect()]


def test_large_files_become_many_tasks(tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(5 << 30)  # a hole, not data
    parts = ranges._AnnexBReader(str(tmp_path), 64 << 20, False).partitions()
    assert len(parts) == 80 and parts[0].start == 0 and parts[-1].end == 5 << 30
    assert all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))
    parts = ranges._RawFrameReader(str(tmp_path), 1920, 1080, 64 << 20).partitions()
    assert all((p.end - p.start) % 3110400 == 0 for p in parts) and len(parts) > 70 and parts[-1].end == (5 << 30) // 3110400 * 3110400
    with pytest.raises(FileNotFoundError):
        ranges.list_files(str(tmp_path / "none"))


def raw(seed, w, h, n, near=None):
    rng = np.random.default_rng(seed)
    record = sum(a * b for _, a, b in ranges.plane_sizes(w, h))
    data = rng.integers(0, 256, n * record, dtype=np.uint8) if near is None else np.frombuffer(near, np.uint8).copy()
    if near is not None:
        at = rng.choice(len(data), len(data) // 40, replace=False)
        data[at] += rng.integers(0, 3, len(at), dtype=np.uint8)
    return data.tobytes()


@pytest.mark.parametrize("w, h, split_bytes", [(5, 3, 1), (16, 16, 1000), (7, 8, 1 << 20)])
def test_planes_compared_without_exploding(spark, tmp_path, w, h, split_bytes):
    one = raw(3, w, h, 9)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "f").write_bytes(one + b"cut off")
    (tmp_path / "b" / "f").write_bytes(raw(4, w, h, 9, one)[: len(one) - 1])  # its last frame is cut off
    a, b = (ranges.read_raw_frames(spark, str(tmp_path / s), w, h, split_bytes).drop("stream_id") for s in "ab")
    assert (a.select("frame").distinct().count(), b.select("frame").distinct().count()) == (9, 8)
    pairs = planes.pair_planes(a, b, ["frame", "plane"])
    partials = planes.plane_partials(pairs, ["frame", "plane", "width"])
    assert "Generate" not in partials._jdf.queryExecution().executedPlan().toString()
    both = frames.samples(a, ["frame"]).join(frames.samples(b, ["frame"]).withColumnRenamed("value", "other"), ["frame", "plane", "place"])
    columns = ["frame", "plane", "samples", "sse", "differing", "max_diff", "mean_a", "mean_b", "psnr"]
    want = compare.plane_quality(both, ["frame", "plane"], F.col("value"), F.col("other")).select(columns).orderBy("frame", "plane").collect()
    merged = planes.merge_partials(partials.where("samples > 0"), ["frame", "plane"]).select(columns).orderBy("frame", "plane").collect()
    assert len(want) == len(merged) == 24
    for x, y in zip(merged, want, strict=True):
        assert x[:6] == y[:6] and x[6:] == pytest.approx(y[6:])
    order = planes.plane_order(F.col("plane"))
    first = compare.first_difference(both.withColumn("k", F.lit(1)).withColumn("p", order), ["k"], ["frame", "p", "place", "value", "other"], F.col("value") != F.col("other")).first()
    whole = planes.merge_partials(partials.where("samples > 0").withColumn("p", order), [], ["frame", "p"]).first()
    assert (first.frame, first.p, first.place, first.value, first.other) == (whole.first.frame, whole.first.p, whole.first.first_at, whole.first.first_a, whole.first.first_b)
    missing = partials.where("frame = 8").collect()
    assert [(r.samples, r.sse, r.same_size, r.first_at) for r in missing] == [(0, 0, False, None)] * 3


def test_odd_planes(spark):
    rows = [(1, bytearray(b"abc"), bytearray(b"abd")), (2, None, bytearray(b"x")), (3, bytearray(b""), bytearray(b"")), (4, bytearray(b"aa"), bytearray(b"a")), (None, bytearray(b"\xff"), bytearray(b"\x00"))]
    found = planes.plane_partials(spark.createDataFrame(rows, "k int, a binary, b binary"), ["k"])
    got = {r.k: tuple(r)[1:] for r in found.collect()}
    assert got[1] == (3, 1, 1, 1, 294, 295, 2, 99, 100, True) and got[2] == (0, 0, 0, 0, 0, 0, None, None, None, False)
    assert got[3][0] == 0 and got[3][-1] and got[4] == (1, 0, 0, 0, 97, 97, None, None, None, False)
    assert got[None][:4] == (1, 65025, 1, 255)
    assert planes.plane_partials(spark.createDataFrame([], "k int, a binary, b binary"), ["k"]).count() == 0
    assert planes.merge_partials(found.where("k = 3"), ["k"]).first().psnr == float("inf")
    place = spark.range(1).select(planes.place_in_frame(F.lit(53), F.lit(10), F.lit("U")).alias("p")).first().p
    assert (place.x, place.y, place.mb_x, place.mb_y) == (3, 5, 0, 0)
