"""Decoded planes from and to files: raw yuv420p, colour and grey PNG. Files are read and written by the executors."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lumaframe.sources.ranges import store_of

FRAMES = "stream_id string, frame long, plane string, width int, height int, data binary"


def samples(planes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plane, place and value: one row for each sample. ``place`` is the raster place, from 0."""
    # Each byte as two hex digits: no Python, and no sign to undo.
    digits = F.transform(F.sequence(F.lit(0), F.octet_length("data") - 1), lambda i: F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("int"))
    return planes.where(F.octet_length("data") > 0).select(*keys, "plane", F.posexplode(digits).alias("place", "value"))


def frames_wide(planes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each frame: keys, width, height (of luma) and the planes y, u, v."""
    pick = lambda name, what: F.max(F.when(F.col("plane") == name, F.col(what)))
    return planes.where("data is not null").groupBy(*keys).agg(pick("Y", "width").alias("width"), pick("Y", "height").alias("height"), *[pick(p, "data").alias(p.lower()) for p in "YUV"])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (h, w) grey or (h, w, 3) colour samples."""
    h, w = pixels.shape[:2]
    lines = np.zeros((h, 1 + pixels[0].size), np.uint8)
    lines[:, 1:] = pixels.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes())) + _chunk(b"IEND", b"")


def to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Full-range BT.601 in integers; chroma samples are repeated."""
    grown = [np.repeat(np.repeat(c.astype(np.int64), 2, 0), 2, 1)[: y.shape[0], : y.shape[1]] - 128 for c in (u, v)]
    y, (cb, cr) = y.astype(np.int64), grown
    return np.clip(np.stack([y + (cr * 1436 >> 10), y - (cb * 352 + cr * 731 >> 10), y + (cb * 1814 >> 10)], 2), 0, 255).astype(np.uint8)


def _encoded(row: dict, kind: str) -> bytes:
    if any(row[p] is None for p in ("y" if kind == "grey" else "yuv")):
        raise ValueError(f"frame {row['file']} lacks a plane")
    if kind == "yuv":
        return row["y"] + row["u"] + row["v"]
    h, w = row["height"], row["width"]
    y = np.frombuffer(row["y"], np.uint8).reshape(h, w)
    if kind == "grey":
        return png(y)
    u, v = (np.frombuffer(row[p], np.uint8).reshape((h + 1) // 2, (w + 1) // 2) for p in "uv")
    return png(to_rgb(y, u, v))


@dataclass
class _Written(WriterCommitMessage):
    files: int
    size: int


class FrameFiles(DataSource):
    """``frame_files``: a sink of one file a row; see write_frames."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _FrameWriter(self.options["path"], self.options.get("kind", "yuv"))


class _FrameWriter(DataSourceArrowWriter):
    """A task writes its files aside and moves them into place when all are whole; the job's commit clears what is left aside and marks success."""

    def __init__(self, path: str, kind: str):
        if kind not in ("yuv", "colour", "grey"):
            raise ValueError(f"frames are written as yuv, colour or grey, not {kind}")
        self.path, self.kind, self.job = path, kind, uuid.uuid4().hex

    def _aside(self, base: str) -> str:
        return f"{base}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.path)
        aside, names, size = f"{self._aside(base)}/{uuid.uuid4().hex}", [], 0  # a folder for each attempt
        store.create_dir(aside)
        for batch in iterator:
            for row in batch.to_pylist():
                body = _encoded(row, self.kind)
                with store.open_output_stream(f"{aside}/{row['file']}") as out:
                    out.write(body)
                names.append(row["file"])
                size += len(body)
        for name in names:  # a move replaces what an earlier attempt moved
            store.move(f"{aside}/{name}", f"{base}/{name}")
        return _Written(len(names), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = store_of(self.path)
        self._clear(store, base)
        with store.open_output_stream(f"{base}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in messages if m)} {sum(m.size for m in messages if m)}\n".encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store: pyarrow.fs.FileSystem, base: str) -> None:
        if store.get_file_info(self._aside(base)).type == pyarrow.fs.FileType.Directory:
            store.delete_dir(self._aside(base))


def write_frames(planes: DataFrame, keys: list[str], name: Column, folder: str, kind: str = "yuv") -> None:
    """Write one file for each frame: raw yuv420p, or a colour or grey PNG.

    ``name`` is a string Column, the file's name in ``folder``, a folder that
    all executors share. Files are written when this is called, once, and
    appear whole: a task that fails or is run again leaves one file a frame,
    and _SUCCESS gives the number of files and bytes when all are there. A
    frame that lacks a plane fails the job.
    """
    planes.sparkSession.dataSource.register(FrameFiles)
    wide = frames_wide(planes, keys).select(name.alias("file"), "width", "height", "y", "u", "v")
    wide.write.format("frame_files").option("kind", kind).mode("append").save(folder)
