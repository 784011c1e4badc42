"""Prediction, motion, deblocking and the decoding kernel, on streams written here."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaframe.functions import deblock, motion, prediction
from lumaframe.operators.decode import decode_pictures
from lumaframe.sources import annexb, frames, ranges, traces
from lumaframe.streaming.pictures import arriving_streams, write_pictures
from test_annexb import Writer, pps, sps, unit

RNG = np.random.default_rng(5)


def slice_start(kind, frame, poc, idr):
    """A header without deblocking, up to the first macroblock."""
    w = Writer().ue(0, kind, 0).u(4, frame)
    w = w.ue(0) if idr else w
    w = w.u(4, poc)
    if not idr:
        w = w.u(1, 0).u(1, 0)
    w = w.u(2, 0) if idr else w.u(1, 0)
    return w.se(0).ue(1)


def raw_picture(planes, wide, high):
    w = slice_start(7, 0, 0, True)
    for my in range(high):
        for mx in range(wide):
            w.ue(25)
            w.bits += "0" * (-len(w.bits) % 8)
            for plane, n in zip(planes, (16, 8, 8), strict=True):
                for v in plane[n * my : n * my + n, n * mx : n * mx + n].ravel().tolist():
                    w.u(8, v)
    return w.done()


def random_planes(wide=3, high=2):
    return [RNG.integers(1, 256, (n * high, n * wide)) for n in (16, 8, 8)]


def pictures(spark, stream):
    units = annexb.nal_units(spark.createDataFrame([("s", bytearray(stream))], "stream_id string, content binary"))
    out = {}
    for r in decode_pictures(units).collect():
        out[r.gop, r.decode_idx, r.plane] = r
    return out


def samples_of(row):
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width)


def test_raw_then_moved(spark):
    planes = random_planes()
    moved = slice_start(5, 1, 2, False).ue(0, 0).se(8).se(-4).ue(0)  # the first macroblock by (2, -1) whole samples
    moved = moved.ue(0, 0).se(0).se(0).ue(0).ue(4).done()
    start = unit(7, sps()) + unit(8, pps())
    found = pictures(spark, start + unit(5, raw_picture(planes, 3, 2)) + unit(1, moved, 2) + start + unit(5, raw_picture(planes, 3, 2)))
    assert {r.status for r in found.values()} == {"ok"} and len(found) == 9
    for gop in (1, 2):
        for name, plane, (h, w) in zip("YUV", planes, ((20, 40), (10, 20), (10, 20)), strict=True):
            assert (samples_of(found[gop, 0, name]) == plane[:h, :w]).all()
    y = samples_of(found[1, 1, "Y"])
    rows = np.clip(np.arange(16) - 1, 0, None)
    assert (y[:16, :16] == planes[0][np.ix_(rows, np.arange(2, 18))]).all()
    assert (y[:16, 16:32] == planes[0][np.ix_(rows, np.arange(18, 34))]).all(), "a zero difference keeps the left vector"
    assert found[1, 1, "Y"].full_poc == 2 and not found[1, 1, "Y"].is_idr


def test_all_skipped_repeats_the_picture(spark):
    planes = random_planes()
    stream = unit(7, sps()) + unit(8, pps()) + unit(5, raw_picture(planes, 3, 2)) + unit(1, slice_start(5, 1, 2, False).ue(6).done(), 2)
    found = pictures(spark, stream)
    assert all(found[1, 0, p].data == found[1, 1, p].data for p in "YUV")


def test_intra_pictures_and_unsupported(spark):
    grey = slice_start(7, 0, 0, True)
    for at in range(6):
        if at % 2:
            grey.ue(3, 0).se(0).u(1, 1)  # 16x16 DC without coefficients
        else:
            grey.ue(0).u(16, 0xFFFF).ue(0, 3)  # 4x4 blocks of the predicted mode
    start = unit(7, sps()) + unit(8, pps())
    found = pictures(spark, start + unit(5, grey.done()))
    assert all((samples_of(found[1, 0, p]) == 128).all() for p in "YUV")
    bad = slice_start(7, 0, 0, True).ue(0).u(16, 0xFFFF).ue(0, 0).done()
    (only,) = pictures(spark, start + unit(5, bad)).values()
    assert only.status == "unsupported: residual coefficients" and only.data is None
    (only,) = pictures(spark, unit(5, bad)).values()
    assert only.status == "unsupported: no parameter set"


def test_directional_modes():
    """Against the modes' own description: each sample lies on a line to the edge."""
    left, top, corner = np.array([10, 20, 30, 40]), np.array([1, 2, 3, 4, 5, 6, 7, 8]) * 9, 7
    assert prediction.intra_square(3, left, corner, top)[3, 3] == (top[6] + 3 * top[7] + 2) >> 2
    down = prediction.intra_square(4, left, corner, top)
    assert down[0, 0] == down[3, 3] == (left[0] + 2 * corner + top[0] + 2) >> 2 and down[3, 0] == (left[3] + 2 * left[2] + left[1] + 2) >> 2
    assert prediction.intra_square(5, left, corner, top)[0, 0] == (corner + top[0] + 1) >> 1
    assert prediction.intra_square(6, left, corner, top)[0, 0] == (corner + left[0] + 1) >> 1
    assert prediction.intra_square(7, left, corner, top)[1, 0] == (top[0] + 2 * top[1] + top[2] + 2) >> 2
    up = prediction.intra_square(8, left, corner, top)
    assert up[0, 0] == 15 and up[3, 3] == 40 and up[2, 1] == (left[2] + 3 * left[3] + 2) >> 2
    # Transposing the edges turns vertical-right into horizontal-down.
    a, b = RNG.integers(0, 256, 8), RNG.integers(0, 256, 16)
    wide = np.concatenate([a, np.repeat(a[-1], 8)])
    assert (prediction.intra_square(5, a, 50, b) == prediction.intra_square(6, b[:8], 50, wide).T).all()
    for size, f in ((16, prediction.intra_luma16), (8, prediction.intra_chroma)):
        ramp = np.arange(1, size + 1)
        y, x = np.mgrid[0:size, 0:size]
        assert (f(3, ramp * 2, 0, ramp * 3) == 3 * (x + 1) + 2 * (y + 1)).all()


def test_interpolation_of_flat_and_symmetric_planes():
    flat = np.full((24, 24), 93)
    plane = RNG.integers(0, 256, (24, 24))
    for fx in range(4):
        for fy in range(4):
            assert (prediction.inter_luma(flat, 0, 0, 8, 8, (fx, fy)) == 93).all()
            turned = prediction.inter_luma(plane.T, 4, 4, 8, 8, (fy, fx)).T
            assert (prediction.inter_luma(plane, 4, 4, 8, 8, (fx, fy)) == turned).all()
    assert (prediction.inter_luma(plane, 4, 4, 8, 8, (-8, 12)) == plane[7:15, 2:10]).all()
    assert (prediction.inter_chroma(plane, 4, 4, 4, 4, (8, 0)) == plane[4:8, 5:9]).all()


def test_vectors():
    assert motion.predict(0, (0, (4, 0)), (1, (8, 8)), (2, (2, 6))) == (4, 0)
    assert motion.predict(0, (0, (4, 0)), (0, (8, 8)), (2, (2, 6))) == (4, 6)
    assert motion.predict(0, (1, (4, 2)), None, None) == (4, 2)
    assert motion.predict_half(1, "16x8", 0, (0, (4, 0)), (1, (8, 8)), None) == (8, 8)
    assert motion.predict_skip(None, (0, (8, 8)), (0, (8, 8))) == (0, 0) == motion.predict_skip((0, (0, 0)), (0, (8, 8)), (0, (8, 8)))
    assert motion.temporal_scale(4, 0, 8) == 128 and motion.temporal_vectors((10, -6), 128) == ((5, -3), (-5, 3))
    assert motion.direct_refs([((1, (0, 0)), None, (0, (1, 1))), (None, (-1, (0, 0)), None)]) == (0, -1)


def test_deblocking():
    p = np.repeat([[100], [100], [100], [100]], 4, 1)
    q = p + 6
    a, b = deblock.filter_edge(p, q, np.full(4, 4), 40, 0, 0, True)
    line = np.concatenate([a[::-1, 0], b[:, 0]])
    assert (np.diff(line) >= 0).all() and np.diff(line).max() <= 2
    same = deblock.filter_edge(p, p + 200, np.full(4, 4), 40, 0, 0, True)
    assert (same[0] == p).all() and (same[1] == p + 200).all(), "a real edge stays"
    assert deblock.motion_differs([1, 2], [(0, 0), (8, 8)], [2, 1], [(8, 8), (0, 0)]) is False
    assert deblock.motion_differs([1, -1], [(0, 0), (0, 0)], [1, -1], [(4, 0), (0, 0)]) is True
    planes = [np.full((32, 32), 50), np.full((16, 16), 50), np.full((16, 16), 50)]
    left, upper = deblock.strengths(np.ones((2, 2), bool), np.zeros((8, 8), bool), np.full((8, 8, 1), -1), np.zeros((8, 8, 1, 2), int))
    assert (left[:, 0] == 0).all() and (left[:, 4] == 4).all() and (left[:, 1] == 3).all() and (left == upper.T).all()
    deblock.deblock_picture(planes, np.full((2, 2), 40), left, upper)
    assert all((p == 50).all() for p in planes)


@pytest.mark.parametrize("kind", ["yuv", "colour", "grey"])
def test_frames_to_files_and_back(spark, tmp_path, kind):
    rows = [("s", f, n, w, h, bytearray(RNG.integers(0, 256, w * h, dtype=np.uint8).tobytes())) for f in range(2) for n, w, h in (("Y", 6, 4), ("U", 3, 2), ("V", 3, 2))]
    planes = spark.createDataFrame(rows, frames.FRAMES)
    name = F.format_string("frame_%04d", "frame")
    frames.write_frames(planes, ["stream_id", "frame"], name, f"file://{tmp_path}", kind)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["_SUCCESS", "frame_0000", "frame_0001"]
    body = (tmp_path / "frame_0001").read_bytes()
    if kind == "yuv":
        (tmp_path / "all").write_bytes((tmp_path / "frame_0000").read_bytes() + body + b"cut")
        back = ranges.read_raw_frames(spark, f"{tmp_path}/all", 6, 4)
        assert {(r.frame, r.plane, bytes(r.data)) for r in back.collect()} == {(r[1], r[2], bytes(r[5])) for r in rows}
        some = frames.samples(back.where("frame = 1 and plane = 'U'"), ["frame"]).orderBy("place").collect()
        assert bytes(r.value for r in some) == bytes(rows[4][5])
    else:
        at = body.index(b"IDAT")
        size = int.from_bytes(body[at - 4 : at])
        pixels = zlib.decompress(body[at + 4 : at + 4 + size])
        assert len(pixels) == 4 * (1 + (6 if kind == "grey" else 18))
        assert kind != "grey" or pixels[1:7] == bytes(rows[3][5])[:6]


def test_traces(spark, tmp_path):
    (tmp_path / "t.txt").write_text("nal=1 frame=7\n x=1 y=2 mv=-3\nnoise\n x=2 y=2 mv=4\nnal=2 frame=8\r\n x=1 y=2 mv=5\n")
    lines = traces.read_lines(spark, str(tmp_path / "t.txt"))
    rows = traces.extract_below(lines, {"nal": r"nal=(\d+)", "frame": r"frame=(\d+)"}, r"x=(\d+) y=(\d+) mv=(-?\d+)", {"x": "int", "y": "int", "mv": "int"})
    assert [(r.nal, r.frame, r.x, r.mv) for r in rows.orderBy("line_no").collect()] == [(1, 7, 1, -3), (1, 7, 2, 4), (2, 8, 1, 5)]
    (tmp_path / "i.txt").write_text("[x] n:   3 pts: 1 iskey:0 type:B checksum:AB mean:[101.5 128 127] stdev:[20.5 1.0 1.0]\nother\n")
    (only,) = traces.frame_infos(traces.read_lines(spark, str(tmp_path / "i.txt"))).collect()
    assert (only.n, only.is_key, only.type, only["mean"], only["stdev"]) == (3, False, "B", 101.5, 20.5)
    (hexed,) = traces.extract(spark.createDataFrame([("f", 0, "cbp=2f")], "file string, line_no long, line string"), "cbp=([0-9a-f]+)", {"cbp": "hex"}).collect()
    assert hexed.cbp == 47


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng = random.Random(2)
    for i in range(2):
        (tmp_path / "in" / f"{rng.random()}.h264").write_bytes(unit(7, sps()) + unit(8, pps()) + unit(5, raw_picture(random_planes(), 3, 2)))
        write_pictures(arriving_streams(spark, str(tmp_path / "in")), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 3 * (i + 1)
