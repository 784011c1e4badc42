"""Files as byte ranges: splittable sources of Annex B streams and of raw yuv420p frames.

A file of any size is planned as ranges of about ``split_bytes``, one a task.
Files are opened by their URI with Arrow's file systems, by the driver to list
them and by the executors to read them; one without a scheme is local.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
#: Bytes that one read asks for, and bytes of payload in one Arrow batch, about.
READ_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Ranges whose counts may be broadcast, at most.
BROADCAST_RANGES = 200_000
_START = b"\x00\x00\x01"


@dataclass
class ByteRange(InputPartition):
    """Bytes from ``start`` up to ``end`` of a file; ``stream`` is the name that its rows bear."""

    uri: str
    stream: str
    start: int
    end: int
    size: int


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
    return pyarrow.fs.LocalFileSystem(), uri


def list_files(uri: str) -> list[tuple[str, str, int]]:
    """(uri, stream name, size) of a file, or of the files in a folder by name; hidden ones are left out.

    Streams are named as Spark's own file sources name them.
    """
    store, path = store_of(uri)
    info = store.get_file_info(path)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else [f for f in store.get_file_info(pyarrow.fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
    found.sort(key=lambda f: f.path)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return [(f"file://{f.path}", f"file:{f.path}", f.size) for f in found]
    host = re.match("^[^:]+://[^/]*" if path.startswith("/") else "^[^:]+://", uri).group()
    return [(host + f.path, host + f.path, f.size) for f in found]


def cut(files: list[tuple[str, str, int]], step: int) -> list[ByteRange]:
    """Ranges of ``step`` bytes of every file, in order; an empty file has none."""
    return [ByteRange(uri, stream, at, min(at + step, size), size) for uri, stream, size in files for at in range(0, size, step)]


def units_of_range(file: BinaryIO, start: int, end: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[int, bytes]]:
    """(offset, unit) for each start code that begins in [start, end): its place in the file and the bytes up to the next one.

    Reading goes on past ``end`` until the last unit is whole. Zeros that trail
    a unit go; one of nothing else is left out. Only the unit that is being
    read is held.
    """
    file.seek(start)
    held, base, seen, unit = bytearray(), start, 0, -1  # base: place of held[0]; seen: where the search goes on; unit: start code of the open unit
    while True:
        at = held.find(_START, seen)
        if at >= 0:
            if unit >= 0 and (body := bytes(held[unit + 3 - base : at]).rstrip(b"\x00")):
                yield unit, body
            unit = base + at
            if unit >= end:
                return
            del held[:at]
            base, seen = unit, 3
            continue
        seen = max(seen, len(held) - 2)
        if unit < 0:
            del held[:seen]
            base, seen = base + seen, 0
            if base >= end:
                return
        more = file.read(read_bytes)
        if not more:
            break
        held += more
    if unit >= 0 and (body := bytes(held[unit + 3 - base :]).rstrip(b"\x00")):
        yield unit, body


_UNITS = "stream_id string, range_start long, in_range long, byte_at long, ref_idc int, nal_type int, payload binary"
_COUNTS = "stream_id string, range_start long, n long"


class AnnexB(DataSource):
    """``annexb``: NAL units of Annex B streams, one partition for each byte range; ``what`` is units or counts (units a range)."""

    @classmethod
    def name(cls) -> str:
        return "annexb"

    def schema(self) -> str:
        return _COUNTS if self.options.get("what") == "counts" else _UNITS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _AnnexBReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)), self.options.get("what") == "counts")


class _AnnexBReader(DataSourceReader):
    def __init__(self, path: str, step: int, count: bool):
        self.path, self.step, self.count = path, step, count

    def partitions(self) -> list[ByteRange]:
        return cut(list_files(self.path), self.step)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        store, path = store_of(part.uri)
        with store.open_input_file(path) as file:
            found = units_of_range(file, part.start, part.end)
            if self.count:
                yield pa.RecordBatch.from_arrays([pa.array([part.stream]), pa.array([part.start], pa.int64()), pa.array([sum(1 for _ in found)], pa.int64())], names=["stream_id", "range_start", "n"])
                return
            rows, held, first = [], 0, 0
            for at, unit in found:
                rows.append((at, unit[0] >> 5 & 3, unit[0] & 31, unit[1:]))
                held += len(unit)
                if held >= BATCH_BYTES:
                    yield self._batch(part, first, rows)
                    first, rows, held = first + len(rows), [], 0
            if rows:
                yield self._batch(part, first, rows)

    def _batch(self, part: ByteRange, first: int, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        at, ref_idc, kind, payload = zip(*rows, strict=True)
        columns = [pa.array([part.stream] * n), pa.array([part.start] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(at, pa.int64()), pa.array(ref_idc, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["stream_id", "range_start", "in_range", "byte_at", "ref_idc", "nal_type", "payload"])


def read_units(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, numbered: bool = True) -> DataFrame:
    """(stream_id, nal_idx, ref_idc, nal_type, payload) of every unit of a file or a folder of files, whatever their sizes.

    A range owns the start codes that begin in it. Units are numbered from 0
    by a first pass that counts each range's units; a range's first number is
    the sum of those before it in its file. ``numbered=False`` saves that pass
    and gives the start code's place in the file as nal_idx, which orders the
    units as well. No window runs over units.
    """
    spark.dataSource.register(AnnexB)
    source = spark.read.format("annexb").option("split_bytes", split_bytes)
    units = source.load(path)
    if not numbered:
        return units.select("stream_id", F.col("byte_at").alias("nal_idx"), "ref_idc", "nal_type", "payload")
    counts = source.option("what", "counts").load(path)
    before = Window.partitionBy("stream_id").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("stream_id", "range_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    few = sum(-(-size // split_bytes) for *_, size in list_files(path)) <= BROADCAST_RANGES
    firsts = F.broadcast(firsts) if few else firsts
    return units.join(firsts, ["stream_id", "range_start"]).select("stream_id", (F.col("first") + F.col("in_range")).alias("nal_idx"), "ref_idc", "nal_type", "payload")


_PLANES = "stream_id string, frame long, plane string, width int, height int, data binary"


def plane_sizes(width: int, height: int) -> list[tuple[str, int, int]]:
    half = (width + 1) // 2, (height + 1) // 2
    return [("Y", width, height), ("U", *half), ("V", *half)]


class RawFrames(DataSource):
    """``yuv420p``: planes of raw frames one behind the other; partitions hold whole frames."""

    @classmethod
    def name(cls) -> str:
        return "yuv420p"

    def schema(self) -> str:
        return _PLANES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RawFrameReader(self.options["path"], int(self.options["width"]), int(self.options["height"]), int(self.options.get("split_bytes", SPLIT_BYTES)))


class _RawFrameReader(DataSourceReader):
    def __init__(self, path: str, width: int, height: int, split_bytes: int):
        if width <= 0 or height <= 0:
            raise ValueError(f"frames need a width and a height, got {width} x {height}")
        self.path, self.sizes = path, plane_sizes(width, height)
        self.record = sum(w * h for _, w, h in self.sizes)
        self.step = max(1, split_bytes // self.record) * self.record

    def partitions(self) -> list[ByteRange]:
        return cut([(uri, stream, size - size % self.record) for uri, stream, size in list_files(self.path)], self.step)

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        store, path = store_of(part.uri)
        together = max(1, BATCH_BYTES // self.record)
        with store.open_input_file(path) as file:
            for at in range(part.start, part.end, together * self.record):
                file.seek(at)
                raw = memoryview(file.read(min(together * self.record, part.end - at)))
                rows, place = [], 0
                while place < len(raw):
                    for plane, w, h in self.sizes:
                        rows.append((part.stream, (at + place) // self.record if plane == "Y" else rows[-1][1], plane, w, h, bytes(raw[place : place + w * h])))
                        place += w * h
                types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["stream_id", "frame", "plane", "width", "height", "data"])


def read_raw_frames(spark: SparkSession, path: str, width: int, height: int, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(stream_id, frame, plane, width, height, data) of files of consecutive frames, planned by ranges of whole frames; a cut-off last frame is left out."""
    spark.dataSource.register(RawFrames)
    return spark.read.format("yuv420p").option("width", width).option("height", height).option("split_bytes", split_bytes).load(path)
