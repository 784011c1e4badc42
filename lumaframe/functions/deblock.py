"""In-loop deblocking of whole pictures, in place: macroblocks in raster order, vertical edges before horizontal ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.functions.scalar import CHROMA_QP, clip3

#: Edge thresholds by clipped index 0..51, and clipping bounds by index for strengths 1, 2, 3.
ALPHA = [0] * 16 + [4, 4, 5, 6, 7, 8, 9, 10, 12, 13, 15, 17, 20, 22, 25, 28, 32, 36, 40, 45, 50, 56, 63, 71, 80, 90, 101, 113, 127, 144, 162, 182, 203, 226, 255, 255]
BETA = [0] * 16 + [2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 11, 11, 12, 12, 13, 13, 14, 14, 15, 15, 16, 16, 17, 17, 18, 18]
BOUNDS = {
    1: [0] * 23 + [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13],
    2: [0] * 21 + [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 8, 10, 11, 12, 13, 15, 17],
    3: [0] * 17 + [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 23, 25],
}
_BOUND_TABLE = np.array([[0] * 52, BOUNDS[1], BOUNDS[2], BOUNDS[3], [0] * 52])


def limits(qp: Column, offset: Column, strength: Column) -> list[Column]:
    """alpha, beta and the clipping bound of strengths 1 to 3 (0 for others), as columns."""
    at = clip3(0, 51, (qp + offset).cast("int"))
    table = lambda values: F.get(F.array(*map(F.lit, values)), at)
    bound = F.when(strength == 1, table(BOUNDS[1])).when(strength == 2, table(BOUNDS[2])).when(strength == 3, table(BOUNDS[3])).otherwise(0)
    return [table(ALPHA).alias("alpha"), table(BETA).alias("beta"), bound.alias("bound")]


def edge_strengths(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Strengths 0 to 4 of every edge between 4x4 blocks and of macroblock edges: keys, mb_x, mb_y, direction, edge, bs (array of 4).

    blocks: one row a macroblock with intra, is_b, transform_8x8, and arrays of
    16 in raster order: nz (coded coefficients), ref0, ref1, x0, y0, x1, y1.
    Edges are numbered 0 (the macroblock's own edge, against its neighbour) to
    3. Where a neighbour is missing only intra macroblocks have a strength;
    inside 8x8-transform macroblocks only edge 2 has. Inner edges are made in
    the row; for own edges the four facing values of both sides meet. Pictures
    are dealt over tasks, once, and streamed in raster order through a kernel
    that holds two rows of macroblocks: the rule as an expression is too large
    to compile, and joins with both neighbours cost two sorts more.
    """
    at = [*keys, "mb_x", "mb_y"]
    schema = T.StructType([*[blocks.schema[c] for c in at], T.StructField("direction", T.StringType()), T.StructField("edge", T.IntegerType()), T.StructField("bs", T.ArrayType(T.IntegerType()))])
    values = F.flatten(F.array(*[F.col(n).cast("array<int>") for n in _ARRAYS])).alias("_values")
    rows = blocks.select(*at, "intra", "is_b", "transform_8x8", values)
    in_order = rows.repartition(*keys).sortWithinPartitions(*keys, "mb_y", "mb_x")
    return in_order.mapInArrow(partial(_edges, keys=keys, schema=to_arrow_schema(schema)), schema)


_ARRAYS = ["nz", "ref0", "ref1", "x0", "y0", "x1", "y1"]


def _lines(here: dict[str, np.ndarray], there: dict[str, np.ndarray], is_b: np.ndarray) -> np.ndarray:
    """2 where either side holds coefficients, 1 where motion breaks, else 0; arrays of (rows, 4 lines)."""

    def alike(i: int, j: int) -> np.ndarray:
        ref = here[f"ref{i}"]
        near = (np.abs(here[f"x{i}"] - there[f"x{j}"]) < 4) & (np.abs(here[f"y{i}"] - there[f"y{j}"]) < 4)
        return (ref == there[f"ref{j}"]) & ((ref < 0) | near)

    either_way = (alike(0, 0) & alike(1, 1)) | (alike(0, 1) & alike(1, 0))
    moved = ~np.where(is_b[:, None], either_way, alike(0, 0))
    return np.where((here["nz"] != 0) | (there["nz"] != 0), 2, moved.astype(np.int32))


def _edges(batches: Iterator[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """All edges of pictures in raster order; between batches it keeps the last row of macroblocks and the one being read."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        old = sum(b.num_rows for b in kept)
        whole = pa.Table.from_batches([*kept, batch]).combine_chunks().to_batches()
        if not whole:
            continue
        rows = whole[0]
        x, y = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mb_x", "mb_y"))
        picture = np.zeros(len(x), np.int64)
        for k in keys:
            codes = pc.dictionary_encode(rows.column(k), null_encoding="encode").indices.to_numpy()
            picture[1:] |= codes[1:] != codes[:-1]
        place = np.cumsum(picture) << 40 | y << 20 | x  # rises, since the rows are sorted
        # Neighbours by their places; new rows only.
        n, values = rows.num_rows - old, rows.column("_values").flatten().to_numpy().reshape(-1, len(_ARRAYS), 4, 4)
        flag = lambda c: pc.fill_null(rows.column(c), False).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        intra, is_b, whole_8x8 = flag("intra"), flag("is_b"), flag("transform_8x8")[old:]
        made: list[tuple[str, int, np.ndarray]] = []
        for direction, step, at in (("v", 1, x), ("h", 1 << 20, y)):
            line = lambda v, k: {c: v[:, i, :, k] if direction == "v" else v[:, i, k] for i, c in enumerate(_ARRAYS)}  # noqa: B023, E731
            wanted = place[old:] - step
            near = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            found = (place[near] == wanted) & (at[old:] > 0)
            own = _lines(line(values[old:], 0), line(values[near], 3), is_b[old:] | is_b[near])
            either = intra[old:] | (intra[near] & found)
            made.append((direction, 0, np.where(either[:, None], 4, np.where(found[:, None], own, 0))))
            for edge in (1, 2, 3):
                bs = np.where(intra[old:, None], 3, _lines(line(values[old:], edge), line(values[old:], edge - 1), is_b[old:]))
                made.append((direction, edge, np.where(whole_8x8[:, None], 0, bs) if edge != 2 else bs))
        from_ = np.searchsorted(place, (place[-1] >> 40 << 40) | max(0, int(y[-1]) - 1) << 20)
        kept, batch = [rows.slice(int(from_))], rows.slice(old)
        at = [*keys, "mb_x", "mb_y"]
        for direction, edge, bs in made:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * n + 1, 4, dtype=np.int32)), pa.array(bs.reshape(-1).astype(np.int32)))
            columns = [*[batch.column(c) for c in at], pa.array([direction] * n), pa.array([edge] * n, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filter_edge(p: np.ndarray, q: np.ndarray, strength: np.ndarray, qp: int, alpha_offset: int, beta_offset: int, luma: bool) -> tuple[np.ndarray, np.ndarray]:
    """Samples beside an edge, filtered: ``p`` and ``q`` are (depth, n), nearest first; strength is (n,)."""
    p, q = p.astype(np.int64), q.astype(np.int64)
    a_index, b_index = max(0, min(51, qp + alpha_offset)), max(0, min(51, qp + beta_offset))
    alpha, beta = ALPHA[a_index], BETA[b_index]
    on = (strength > 0) & (np.abs(p[0] - q[0]) < alpha) & (np.abs(p[1] - p[0]) < beta) & (np.abs(q[1] - q[0]) < beta)
    if not on.any():
        return p, q
    flat_p, flat_q = (np.abs(s[2] - s[0]) < beta if luma else np.zeros(len(on), bool) for s in (p, q))
    bound = _BOUND_TABLE[strength, a_index]
    reach = bound + (flat_p.astype(int) + flat_q if luma else 1)
    delta = np.clip((((q[0] - p[0]) << 2) + (p[1] - q[1]) + 4) >> 3, -reach, reach)
    new_p, new_q = p.copy(), q.copy()
    weak, strong = on & (strength < 4), on & (strength == 4)
    new_p[0] = np.where(weak, np.clip(p[0] + delta, 0, 255), p[0])
    new_q[0] = np.where(weak, np.clip(q[0] - delta, 0, 255), q[0])
    small = np.abs(p[0] - q[0]) < (alpha >> 2) + 2
    for new, s, o, flat in ((new_p, p, q, flat_p), (new_q, q, p, flat_q)):
        new[0] = np.where(strong, (2 * s[1] + s[0] + o[1] + 2) >> 2, new[0])
        if luma:
            inner = np.clip((s[2] + ((s[0] + o[0] + 1) >> 1) - 2 * s[1]) >> 1, -bound, bound)
            new[1] = np.where(weak & flat, s[1] + inner, s[1])
            deep = strong & flat & small
            new[0] = np.where(deep, (s[2] + 2 * s[1] + 2 * s[0] + 2 * o[0] + o[1] + 4) >> 3, new[0])
            new[1] = np.where(deep, (s[2] + s[1] + s[0] + o[0] + 2) >> 2, new[1])
            new[2] = np.where(deep, (2 * s[3] + 3 * s[2] + s[1] + s[0] + o[0] + 4) >> 3, new[2])
    return new_p, new_q


def motion_differs(refs_a: list[int], mvs_a: list[tuple[int, int]], refs_b: list[int], mvs_b: list[tuple[int, int]]) -> bool:
    """Whether two blocks use other pictures, or vectors a whole sample or more apart, lists taken in either order.

    References are picture numbers, -1 for a list that is not used.
    """
    used_a = [(r, m) for r, m in zip(refs_a, mvs_a, strict=True) if r >= 0]
    used_b = [(r, m) for r, m in zip(refs_b, mvs_b, strict=True) if r >= 0]
    if sorted(r for r, _ in used_a) != sorted(r for r, _ in used_b):
        return True
    orders = [used_b] if len(used_b) < 2 else [used_b, used_b[::-1]]
    near = lambda u, v: u[0] == v[0] and abs(u[1][0] - v[1][0]) < 4 and abs(u[1][1] - v[1][1]) < 4
    return not any(all(near(u, v) for u, v in zip(used_a, other, strict=True)) for other in orders)


def strengths(intra: np.ndarray, coded: np.ndarray, refs: np.ndarray, mvs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strength of every 4x4 block's left and upper edge; 0 at the picture's edge.

    ``intra`` is (rows, columns) of macroblocks; ``coded`` (4 rows, 4 columns)
    of blocks; ``refs`` adds a last axis of lists and ``mvs`` one of x, y.
    """
    whole = np.repeat(np.repeat(intra, 4, 0), 4, 1)
    out = []
    for axis in (1, 0):
        n = coded.shape[axis]
        here, there = (lambda a: np.take(a, range(1, n), axis)), (lambda a: np.take(a, range(n - 1), axis))
        at_mb = np.expand_dims(np.arange(1, n) % 4 == 0, 1 - axis)
        any_intra, any_coded = here(whole) | there(whole), here(coded) | there(coded)
        s = np.where(any_intra, np.where(at_mb, 4, 3), np.where(any_coded, 2, 0))
        ra, rb, ma, mb = here(refs), there(refs), here(mvs), there(mvs)
        for y, x in zip(*np.nonzero(s == 0), strict=True):
            s[y, x] = motion_differs(ra[y, x].tolist(), [tuple(m) for m in ma[y, x].tolist()], rb[y, x].tolist(), [tuple(m) for m in mb[y, x].tolist()])
        full = np.zeros(coded.shape, np.int64)
        full[(slice(None), slice(1, None)) if axis == 1 else (slice(1, None), slice(None))] = s
        out.append(full)
    return out[0], out[1]


def deblock_picture(planes: list[np.ndarray], qp: np.ndarray, left: np.ndarray, upper: np.ndarray, *, alpha_offset: int = 0, beta_offset: int = 0, chroma_offsets: tuple[int, int] = (0, 0), transform_8x8: np.ndarray | None = None) -> None:
    """Filter Y, U and V in place. ``qp`` is one quantiser a macroblock; ``left`` and ``upper`` come from strengths()."""
    rows, cols = qp.shape
    chroma_qp = [np.array(CHROMA_QP)[np.clip(qp + o, 0, 51)] for o in chroma_offsets]
    for my in range(rows):
        for mx in range(cols):
            large = transform_8x8 is not None and bool(transform_8x8[my, mx])
            for vertical in (True, False):
                table = left if vertical else upper
                oy, ox = (my, mx - 1) if vertical else (my - 1, mx)
                for edge in range(4):
                    if edge == 0 and (oy < 0 or ox < 0) or edge % 2 and large:
                        continue
                    s = table[4 * my : 4 * my + 4, 4 * mx + edge] if vertical else table[4 * my + edge, 4 * mx : 4 * mx + 4]
                    if not s.any():
                        continue
                    for i, plane in enumerate(planes):
                        if i and edge % 2:
                            continue
                        q_here = qp if i == 0 else chroma_qp[i - 1]
                        mean = (int(q_here[my, mx]) + int(q_here[oy, ox]) + 1) >> 1 if edge == 0 else int(q_here[my, mx])
                        size, depth = (16, 4) if i == 0 else (8, 2)
                        step = 4 * edge if i == 0 else 2 * edge
                        view = plane[my * size : my * size + size, :].T if vertical else plane[:, mx * size : mx * size + size]
                        at = (mx if vertical else my) * size + step
                        p, q = filter_edge(view[at - depth : at][::-1], view[at : at + depth], np.repeat(s, size // 4), mean, alpha_offset, beta_offset, i == 0)
                        view[at - depth : at] = p[::-1]
                        view[at : at + depth] = q
