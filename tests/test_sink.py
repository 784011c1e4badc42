"""The sink of frame files under failing, repeated and aborted tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumaframe.sources import frames


def batch(names, size=4):
    rows = [{"file": n, "width": 2, "height": 2, "y": bytes([i]) * size, "u": b"u", "v": b"v"} for i, n in enumerate(names)]
    return pa.RecordBatch.from_pylist(rows)


def test_a_failed_and_repeated_task_leaves_one_whole_file_a_frame(tmp_path):
    writer = frames._FrameWriter(str(tmp_path), "yuv")

    def breaks():
        yield batch(["a", "b"])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    assert not (tmp_path / "a").exists()  # nothing appears before its task is through
    again = writer.write(iter([batch(["a", "b"]), batch(["c"])]))
    twice = writer.write(iter([batch(["a", "b"])]))  # a speculative attempt
    writer.commit([again, None])
    assert sorted(f.name for f in tmp_path.iterdir()) == ["_SUCCESS", "a", "b", "c"]
    assert (tmp_path / "b").read_bytes() == b"\x01\x01\x01\x01uv" and twice.files == 2
    assert (tmp_path / "_SUCCESS").read_text() == "3 18\n"


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    planes = spark.createDataFrame([("s", f, p, 2, 2, bytearray(b"abcd"[: 4 if p == "Y" else 1])) for f in range(6) for p in "YUV" if (f, p) != (5, "V")], frames.FRAMES)
    name = F.format_string("f%d", "frame")
    with pytest.raises(Exception, match="lacks a plane"):
        frames.write_frames(planes.coalesce(1), ["stream_id", "frame"], name, str(tmp_path))
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("_")]
    frames.write_frames(planes.where("frame < 5"), ["stream_id", "frame"], name, str(tmp_path))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["_SUCCESS", "f0", "f1", "f2", "f3", "f4"]
    assert {f.read_bytes() for f in tmp_path.iterdir() if f.name != "_SUCCESS"} == {b"abcdaa"}
    frames.write_frames(planes.where("plane = 'Y'"), ["stream_id", "frame"], name, str(tmp_path / "grey"), "grey")
    assert len(list((tmp_path / "grey").iterdir())) == 7
    with pytest.raises(Exception, match="yuv, colour or grey"):
        frames.write_frames(planes, ["stream_id", "frame"], name, str(tmp_path), "gif")


def test_planning_writes_nothing(spark, tmp_path):
    planes = spark.createDataFrame([("s", 0, "Y", 2, 2, bytearray(b"abcd"))], frames.FRAMES)
    frames.frames_wide(planes, ["stream_id", "frame"]).explain()
    assert not list(tmp_path.iterdir())
