"""Headers of streams in chunks: any cut, and a restart from the checkpoint, give what one batch gives."""

import random

import pytest
from pyspark.sql import functions as F
from test_annexb import header, pps, sps, unit

from lumaframe.sources import annexb
from lumaframe.streaming.headers import HEAD_BYTES, arriving_headers


def units():
    rng = random.Random(9)
    rows = []
    for stream in ("a", "b"):
        data = unit(1, header(idr=False)) + unit(7, sps()) + unit(8, pps())
        for n in range(25):
            data += unit(7, sps(wide=3 + n)) if n == 11 else unit(8, pps(qp=28 + n % 5)) if n % 6 == 4 else b""
            data += unit(5, header(poc=0), 3) if n % 10 == 0 else unit(1, header(idr=False, frame=n % 16, poc=rng.randrange(16)), 2)
        rows += [(stream, i, *u) for i, u in enumerate(annexb.split_units(data))]
    return [(s, i, r, k, bytearray(p)) for s, i, r, k, p in rows]


SCHEMA = "stream_id string, nal_idx long, ref_idc int, nal_type int, payload binary"


@pytest.mark.parametrize("cuts", [[], [1], [2, 3, 17, 30]])
def test_any_cut_and_a_restart(spark, tmp_path, cuts):
    rows = units()
    edges = [0, *cuts, 1000]
    chunks = [[r for r in rows if a <= r[1] < b] for a, b in zip(edges, edges[1:], strict=False)]

    def run():
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        out = arriving_headers(arriving).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True)
        out.start(f"{tmp_path}/out").awaitTermination(200)

    for n, chunk in enumerate(chunks):
        random.Random(n).shuffle(chunk)
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
        if n in (0, 2, len(chunks) - 1):  # a new query, from the checkpoint
            run()
    found = spark.read.parquet(f"{tmp_path}/out")
    want = annexb.slice_headers(spark.createDataFrame(rows, SCHEMA))
    shared = ["stream_id", "nal_idx", "ref_idc", "width", "height", "slice_type", "frame_num", "is_idr", "poc_lsb", "qp", "parse_status"]
    listed = lambda d: sorted(map(tuple, d.select(shared).collect()), key=str)
    assert listed(found) == listed(want)
    for stream in "ab":
        high = last = None
        for r in found.where((F.col("stream_id") == stream) & F.col("width").isNotNull()).orderBy("nal_idx").collect():
            high = 0 if r.is_idr else high + (16 if last - r.poc_lsb >= 8 else -16 if r.poc_lsb - last > 8 else 0)
            last = r.poc_lsb
            assert r.full_poc == high + r.poc_lsb
    assert found.where("parse_status = 'no parameter set'").count() == 2


def test_heads_are_long_enough():
    assert HEAD_BYTES * 8 > 64 * (2 + 6 * 63) + 2 * 66 * 126
