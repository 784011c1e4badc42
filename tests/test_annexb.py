"""Stream splitting, parsing and parameter-set resolution on streams written here bit by bit."""

import random

from lumaframe.functions import blocks
from lumaframe.operators import sequence
from lumaframe.sources import annexb
from pyspark.sql import functions as F


class Writer:
    def __init__(self):
        self.bits = ""

    def u(self, n, v):
        self.bits += format(v, f"0{n}b")
        return self

    def ue(self, *values):
        for v in values:
            code = format(v + 1, "b")
            self.bits += "0" * (len(code) - 1) + code
        return self

    def se(self, v):
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def done(self):
        bits = self.bits + "1"
        bits += "0" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def sps(number=0, wide=3, high=2, crop=(0, 4, 0, 6)):
    w = Writer().u(8, 66).u(8, 0).u(8, 30).ue(number, 0, 0, 0, 1).u(1, 0).ue(wide - 1, high - 1).u(1, 1).u(1, 1).u(1, 1).ue(*crop)
    return w.u(1, 0).done()


def pps(number=0, of=0, qp=28):
    return Writer().ue(number, of).u(2, 0).ue(0, 0, 0).u(3, 0).se(qp - 26).se(0).se(-2).u(3, 4).done()


def header(kind=7, pps_id=0, frame=3, idr=True, poc=5):
    w = Writer().ue(0, kind, pps_id).u(4, frame)
    w = w.ue(1) if idr else w
    w = w.u(4, poc)
    w = w.u(2, 0) if idr else w.u(1, 0).u(1, 0).u(1, 0)
    return w.se(3).ue(1).done()


def unit(kind, payload, idc=3):
    return b"\x00\x00\x00\x01" + bytes([idc << 5 | kind]) + annexb.escape(payload)


def test_split_and_escape():
    rng = random.Random(1)
    payloads = [bytes(rng.choice([0, 0, 1, 2, 3, 9]) for _ in range(rng.randint(1, 60))) + b"\x80" for _ in range(200)]
    assert all(annexb.unescape(annexb.escape(p)) == p for p in payloads)
    found = annexb.split_units(b"".join(unit(1, p) for p in payloads))
    assert [annexb.unescape(p) for _, _, p in found] == payloads and {(i, k) for i, k, _ in found} == {(3, 1)}
    assert annexb.split_units(b"no start code") == [] and annexb.split_units(b"") == []


def test_golomb_round_trip():
    for v in (0, 1, 2, 7, 8, 254, 255, 65535):
        assert annexb.Bits(Writer().ue(v).done()).ue() == v
    for v in range(-9, 10):
        assert annexb.Bits(Writer().se(v).done()).se() == v
    bits = annexb.Bits(b"\xa0")
    assert bits.more_data() and bits.u(1) == 1 and bits.peek(2) == 1 and bits.u(2) == 1 and not bits.more_data()


def test_tables(spark):
    one = unit(7, sps()) + unit(8, pps()) + unit(5, header()) + unit(8, pps(qp=40)) + unit(1, header(0, idr=False, frame=4), 2) + unit(9, b"\xf0", 0)
    two = unit(5, header(pps_id=4))
    streams = spark.createDataFrame([("a", bytearray(one)), ("b", bytearray(two)), ("c", None)], "stream_id string, content binary")
    units = annexb.nal_units(streams)
    assert [r.nal_type for r in units.where("stream_id = 'a'").orderBy("nal_idx").collect()] == [7, 8, 5, 8, 1, 9]
    s = annexb.sps_table(units).first()
    assert (s.width, s.height, s.parse_status) == (40, 20, "ok")
    rows = {(r.stream_id, r.nal_idx): r for r in annexb.slice_headers(units).collect()}
    assert rows["b", 0].parse_status == "no parameter set"
    assert (rows["a", 2].slice_type, rows["a", 2].frame_num, rows["a", 2].poc_lsb, rows["a", 2].qp, rows["a", 2].deblock_idc) == (2, 3, 5, 31, 1)
    assert rows["a", 4].qp == 43 and rows["a", 4].slice_type == 0 and not rows["a", 4].is_idr
    assert units.select(annexb.type_name(F.col("nal_type")).alias("n")).where("n = 'SPS'").count() == 1


def test_picture_order(spark):
    full = [0, 60, 56, 54, 58, 68, 64, 62, 66, 76, 72, 70, 74]
    frame = spark.createDataFrame([("s", i, p, i == 0) for i, p in enumerate(full)], "s string, i int, poc long, idr boolean")
    ordered = sequence.display_order(sequence.assign_gop(frame, "s", "i", F.col("idr")), "s", "i", F.col("poc"))
    assert [r.poc for r in ordered.orderBy("gop", "display_rank").collect()] == sorted(full)
    full = [x for base in range(0, 200, 8) for x in ([0] if not base else [base, base - 4, base - 6, base - 2])]
    frame = spark.createDataFrame([("s", i, p % 64, i == 0) for i, p in enumerate(full)], "s string, i int, lsb long, idr boolean")
    out = sequence.unwrap_poc(frame, "s", "i", F.col("lsb"), 64, F.col("idr"))
    assert [r.full_poc for r in out.orderBy("i").collect()] == full


def test_transforms_of_a_constant_and_by_definition():
    import numpy as np

    for size, f in ((4, blocks.idct4x4), (8, blocks.idct8x8)):
        x = np.zeros((1, size, size), int)
        x[0, 0, 0] = 64 * 5
        assert (f(x) == 5).all()
    assert sorted(blocks.zigzag8()) == list(range(64)) and blocks.zigzag8()[:6] == [0, 1, 8, 16, 9, 2]
