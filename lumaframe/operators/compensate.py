"""Motion compensation over tables: planes cut into overlapping tiles, blocks joined to the one tile they read.

A tile reaches so far past its own square that any block that begins in it
lies inside it whole, filter taps included. So a block reads one tile, what is
shipped are tiles, and a task holds a batch of them, never a picture sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Samples of a tile's own square, and the side of the largest block with the taps of the luma filter.
TILE, REACH = 64, 16 + 5


def plane_tiles(planes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, plane, tile_x, tile_y and tile (binary): planes (width, height, data) as squares of TILE samples with REACH - 1 more to the right and below, as far as the plane goes."""
    schema = T.StructType([*[planes.schema[k] for k in (*keys, "plane")], T.StructField("tile_x", T.IntegerType()), T.StructField("tile_y", T.IntegerType()), T.StructField("tile", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                w, h = batch.column("width")[n].as_py(), batch.column("height")[n].as_py()
                samples = np.frombuffer(batch.column("data")[n].as_buffer(), np.uint8).reshape(h, w)
                places = [(x, y) for y in range(0, h, TILE) for x in range(0, w, TILE)]
                same = [pa.array([batch.column(k)[n].as_py()] * len(places), arrow.field(k).type) for k in (*keys, "plane")]
                bodies = [samples[y : y + TILE + REACH - 1, x : x + TILE + REACH - 1].tobytes() for x, y in places]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array([p[i] // TILE for p in places], pa.int32()) for i in (0, 1)], pa.array(bodies, pa.binary())], schema=arrow)

    return planes.where("data IS NOT NULL AND width > 0 AND height > 0").select(*keys, "plane", "width", "height", "data").mapInArrow(cut, schema)


def _taps(v: np.ndarray, axis: int) -> np.ndarray:
    """The six-tap filter along an axis, which gets shorter by five."""
    v = np.moveaxis(v, axis, -1)
    return np.moveaxis(v[..., :-5] - 5 * v[..., 1:-4] + 20 * v[..., 2:-3] + 20 * v[..., 3:-2] - 5 * v[..., 4:-1] + v[..., 5:], -1, axis)


def luma(window: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Blocks at a quarter-sample phase from their samples with two more before and three behind: (n, h + 5, w + 5) to (n, h, w)."""
    v = window.astype(np.int32)
    h, w = v.shape[1] - 5, v.shape[2] - 5
    whole = lambda dx, dy: v[:, 2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
    level = lambda x: np.clip((x + 16) >> 5, 0, 255)
    across = lambda dy: level(_taps(v, 2)[:, 2 + dy : 2 + dy + h])  # noqa: E731  half a sample to the right
    down = lambda dx: level(_taps(v, 1)[:, :, 2 + dx : 2 + dx + w])
    middle = lambda: np.clip((_taps(_taps(v, 2), 1) + 512) >> 10, 0, 255)
    right, below = int(fx == 3), int(fy == 3)
    if fy == 0:
        ends = [whole(0, 0)] if fx == 0 else [across(0)] if fx == 2 else [whole(right, 0), across(0)]
    elif fx == 0:
        ends = [down(0)] if fy == 2 else [whole(0, below), down(0)]
    elif fx == 2:
        ends = [middle()] if fy == 2 else [across(below), middle()]
    else:
        ends = [down(right), middle()] if fy == 2 else [across(below), down(right)]
    return (ends[0] if len(ends) == 1 else (ends[0] + ends[1] + 1) >> 1).astype(np.uint8)


def chroma(window: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Blocks at an eighth-sample phase by weights of four neighbours: (n, h + 1, w + 1) to (n, h, w)."""
    v = window.astype(np.int32)
    a, b, c, d = v[:, :-1, :-1], v[:, :-1, 1:], v[:, 1:, :-1], v[:, 1:, 1:]
    return (((8 - fx) * (8 - fy) * a + fx * (8 - fy) * b + (8 - fx) * fy * c + fx * fy * d + 32) >> 6).astype(np.uint8)


def _predict(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = ["x", "y", "w", "h", "mvx", "mvy", "width", "height", "tile_x", "tile_y"]
    for batch in batches:
        groups: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        luma_rows = [p == "Y" for p in batch.column("plane").to_pylist()]
        for n, (x, y, w, h, mvx, mvy, width, height, tx, ty) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
            if not batch.column("tile")[n].is_valid:
                continue
            bits, before, more = (2, 2, 5) if luma_rows[n] else (3, 0, 1)
            # Samples past the picture's edge repeat its last ones.
            across = np.clip(np.arange(w + more) + x + (mvx >> bits) - before, 0, width - 1) - tx * TILE
            down = np.clip(np.arange(h + more) + y + (mvy >> bits) - before, 0, height - 1) - ty * TILE
            tile = np.frombuffer(batch.column("tile")[n].as_buffer(), np.uint8).reshape(-1, min(TILE + REACH - 1, width - tx * TILE))
            mask = (1 << bits) - 1
            groups.setdefault((luma_rows[n], w, h, mvx & mask, mvy & mask), []).append((n, tile[np.ix_(down, across)]))
        out: list[bytes | None] = [None] * batch.num_rows
        for (is_luma, _, _, fx, fy), found in groups.items():
            made = (luma if is_luma else chroma)(np.stack([window for _, window in found]), fx, fy)
            for (n, _), block in zip(found, made, strict=True):
                out[n] = block.tobytes()
        yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema if f.name != "predicted"], pa.array(out, pa.binary())], schema=schema)


def compensate(blocks: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` with predicted: the samples (binary, raster order) that their vectors point to in a reference plane.

    blocks: ``keys`` and plane name the plane that is read; x, y, w, h the
    block in samples of it, up to 16 a side; mvx, mvy the vector in quarter
    samples of luma, so eighths of chroma; width and height the plane's size.
    Luma (plane Y) takes the six-tap filter, other planes weights of four
    neighbours. Vectors may point anywhere: the plane's border goes on without
    end. predicted is null where the plane is missing.
    """
    is_luma = F.col("plane") == "Y"

    def tile_of(at: str, vector: str, size: str):
        first = F.col(at) + F.when(is_luma, F.shiftright(vector, 2) - 2).otherwise(F.shiftright(vector, 3))
        return F.floor(F.greatest(F.lit(0), F.least(first, F.col(size) - 1)) / TILE).cast("int")

    placed = blocks.withColumn("tile_x", tile_of("x", "mvx", "width")).withColumn("tile_y", tile_of("y", "mvy", "height"))
    joined = placed.join(plane_tiles(planes, keys).hint("merge"), [*keys, "plane", "tile_x", "tile_y"], "left")
    schema = T.StructType([*[blocks.schema[c] for c in blocks.columns], T.StructField("predicted", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    return joined.mapInArrow(lambda batches: _predict(batches, arrow), schema)
