"""Macroblocks and what their neighbours show them: border strips, contexts, predicted modes, vectors and direct motion.

A macroblock is a row: keys of its picture, mb_x, mb_y and arrays of 16 values,
one for each 4x4 block in raster order. All that a neighbour shows is a strip:
the four values of the column or row that faces the macroblock, or the one in
the corner. Only strips are shipped to the neighbour's place, by equi-joins on
picture and place; a macroblock's own row is shuffled once. Direct motion needs
one block of each neighbour only: there a picture lies in one task, which sorts
its rows and looks neighbours up in them. Rows are unique by picture and place. These are
rules over finished tables; nothing is decoded.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions.scalar import median3, wrap16

#: Where each neighbour lies, and which of its blocks face the macroblock: of four rows of four, and of two rows of two.
SIDES = {"left": (-1, 0, [3, 7, 11, 15], [1, 3]), "top": (0, -1, [12, 13, 14, 15], [2, 3]), "top_left": (-1, -1, [15], [3]), "top_right": (1, -1, [12], [2])}


def with_strips(blocks: DataFrame, keys: list[str], arrays: list[str], sides: list[str], small: list[str] = [], scalars: list[str] = []) -> DataFrame:  # noqa: B006
    """``blocks`` with, for each side, side_name: the facing values of each array, and the neighbour's scalars; all null where there is no neighbour.

    ``small`` are arrays of 4 values, two rows of two.
    """
    at, found = [*keys, "mb_x", "mb_y"], blocks
    for side in sides:
        dx, dy, *places = SIDES[side]
        strip = lambda name, where: F.array(*[F.get(F.col(name), F.lit(p)) for p in where]).alias(f"{side}_{name}")  # noqa: B023, E731
        strips = [*[strip(n, places[0]) for n in arrays], *[strip(n, places[1]) for n in small], *[F.col(s).alias(f"{side}_{s}") for s in scalars]]
        shown = blocks.select(*keys, (F.col("mb_x") - dx).alias("mb_x"), (F.col("mb_y") - dy).alias("mb_y"), *strips)
        found = found.join(shown.hint("merge"), at, "left")  # both sides grow alike, and arrays are larger than Spark expects
    return found


def _beside(name: str, size: int, missing: Column) -> tuple[Column, Column]:
    """For each block of a square array of ``size`` a side: the values left of and above it; the neighbours' strips on the border."""
    here, left, top = (F.col(c) for c in (name, f"left_{name}", f"top_{name}"))
    at = lambda a, i: F.get(a, F.lit(i) if isinstance(i, int) else i)
    one = [F.coalesce(at(here, k - 1) if k % size else at(left, k // size), missing) for k in range(size * size)]
    two = [F.coalesce(at(here, k - size) if k >= size else at(top, k), missing) for k in range(size * size)]
    return F.array(*one), F.array(*two)


def coefficient_contexts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mb_x, mb_y, and contexts of coefficient counts (arrays in raster order).

    blocks: luma (16 counts), cb and cr (4 each). nc_*: the mean, rounded up,
    of the counts left of and above a block; one alone where the other is
    missing, 0 where both are. cbf_*: bit 0 is set where the block on the left
    holds coefficients, bit 1 where the one above does; blocks past the
    picture's edge count as holding some.
    """
    shown = with_strips(blocks.select(*keys, "mb_x", "mb_y", "luma", "cb", "cr"), keys, ["luma"], ["left", "top"], small=["cb", "cr"])
    mean = lambda p: F.when((p["a"] < 0) & (p["b"] < 0), 0).when(p["a"] < 0, p["b"]).when(p["b"] < 0, p["a"]).otherwise(F.floor((p["a"] + p["b"] + 1) / 2)).cast("int")
    flags = lambda p: F.when(p["a"] != 0, 1).otherwise(0) + F.when(p["b"] != 0, 2).otherwise(0)
    columns = []
    for name, size in (("luma", 4), ("cb", 2), ("cr", 2)):
        pairs = F.arrays_zip(*[c.alias(n) for c, n in zip(_beside(name, size, F.lit(-1)), ("a", "b"), strict=True)])
        columns += [F.transform(pairs, mean).alias(f"nc_{name}"), F.transform(pairs, flags).alias(f"cbf_{name}")]
    return shown.select(*keys, "mb_x", "mb_y", *columns)


def pattern_contexts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mb_x, mb_y, left_cbp and top_cbp: the coded block patterns that a macroblock's own is read by.

    blocks: cbp and intra. Of the left one only the two luma groups on its
    right show, in the places of the ones they face, beside chroma and DC
    bits. Past the picture's edge stands 0x00f, for intra macroblocks 0x7cf.
    """
    shown = with_strips(blocks.select(*keys, "mb_x", "mb_y", "cbp", "intra"), keys, [], ["left", "top"], scalars=["cbp"])
    bits = lambda c, mask: c.bitwiseAND(F.lit(mask))
    facing = bits(F.col("left_cbp"), 0x7F0) + bits(F.col("left_cbp"), 2) + bits(F.floor(F.col("left_cbp") / 4).cast("int"), 2) * 4
    edge = F.when(F.col("intra"), 0x7CF).otherwise(0x00F)
    return shown.select(*keys, "mb_x", "mb_y", F.coalesce(facing, edge).alias("left_cbp"), F.coalesce("top_cbp", edge).alias("top_cbp"))


def predicted_modes(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mb_x, mb_y, predicted and raw (arrays of 16) of finished intra 4x4 modes.

    The smaller mode of the blocks on the left and above; 2 where either is
    missing or negative. raw is what is coded for the block's own mode: -1
    where it is the predicted one, else the mode without counting that one.
    """
    shown = with_strips(blocks.select(*keys, "mb_x", "mb_y", "mode"), keys, ["mode"], ["left", "top"])
    a, b = _beside("mode", 4, F.lit(-1))
    least = F.zip_with(a, b, lambda x, y: F.when((x < 0) | (y < 0), 2).otherwise(F.least(x, y)).cast("int"))
    raw = F.zip_with("mode", "predicted", lambda m, p: F.when(m == p, -1).when(m < p, m).otherwise(m - 1).cast("int"))
    return shown.withColumn("predicted", least).select(*keys, "mb_x", "mb_y", "predicted", raw.alias("raw"))


#: Parts of a macroblock by its shape, as (x, y, width, height) in 4x4 blocks.
SHAPES = {
    "16x16": [(0, 0, 4, 4)],
    "16x8": [(0, 0, 4, 2), (0, 2, 4, 2)],
    "8x16": [(0, 0, 2, 4), (2, 0, 2, 4)],
    "8x8": [(0, 0, 2, 2), (2, 0, 2, 2), (0, 2, 2, 2), (2, 2, 2, 2)],
    "skip": [(0, 0, 4, 4)],
}
MISSING = -2
_SPAN = 6  # columns of a grid: one on the left, four of the macroblock, one on the right


def _grid(name: str, missing: int) -> Column:
    """Five rows of six: what lies above, then the macroblock's rows with what lies on their left; nothing on the right has been decoded yet."""
    get = lambda side, i: F.coalesce(F.get(F.col(side), F.lit(i)), F.lit(missing))
    first = [get(f"top_left_{name}", 0), *[get(f"top_{name}", k) for k in range(4)], get(f"top_right_{name}", 0)]
    rest = [v for y in range(4) for v in (get(f"left_{name}", y), *[get(name, 4 * y + x) for x in range(4)], F.lit(missing))]
    return F.array(*[v.cast("int") for v in [*first, *rest]])


def _cells_read(shape: str) -> list[dict[str, int]]:
    """For each part the grid's cells on its left (a), above (b), above right (c) and above left (d), -1 where one is not there yet; its own first block, and the side it looks at first: 0 to 2 for a to c, or -1."""
    parts = SHAPES[shape]
    owner = {(cx, cy): part for part, (x, y, w, h) in enumerate(parts) for cy in range(y, y + h) for cx in range(x, x + w)}
    first = {"16x8": [1, 0], "8x16": [0, 2]}.get(shape, [-1] * len(parts))
    rows = []
    for part, (x, y, w, _) in enumerate(parts):
        there = lambda cx, cy: (cy + 1) * _SPAN + cx + 1 if owner.get((cx, cy), -1) < part else -1  # noqa: B023, E731  blocks outside have no owner; those on the right hold MISSING
        rows.append({"part": part, "a": there(x - 1, y), "b": there(x, y - 1), "c": there(x + w, y - 1), "d": there(x - 1, y - 1), "own": 4 * y + x, "first": first[part]})
    return rows


def _whose(refs: list[Column], ref: Column) -> Column:
    """0 to 2 for the one neighbour of that reference, else 3 for the median of all; 0, the left one, where nothing lies above."""
    a, b, c = (r == ref for r in refs)
    matches = a.cast("int") + b.cast("int") + c.cast("int")
    only_left = (matches == 0) & (refs[1] == MISSING) & (refs[2] == MISSING) & (refs[0] != MISSING)
    return F.when(matches == 1, F.when(a, 0).when(b, 1).otherwise(2)).when(only_left, 0).otherwise(3)


def _median_rule(refs: list[Column], vectors: list[tuple[Column, Column]], ref: Column) -> tuple[Column, Column]:
    """The one neighbour of that reference, else the median of three; the left one where nothing lies above."""
    a, b, c = (r == ref for r in refs)
    matches = a.cast("int") + b.cast("int") + c.cast("int")
    only_left = (matches == 0) & (refs[1] == MISSING) & (refs[2] == MISSING) & (refs[0] != MISSING)

    def pick(axis: int) -> Column:
        x, y, z = (v[axis] for v in vectors)
        one = F.when(a, x).when(b, y).otherwise(z)
        return F.when(matches == 1, one).when(only_left, x).otherwise(median3(x, y, z))

    return pick(0), pick(1)


def predict_vectors(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row a part of every macroblock: keys, mb_x, mb_y, part, ref, pred_x, pred_y, diff_x and diff_y.

    blocks: shape (of SHAPES) and arrays of 16: ref, x, y of the finished
    motion; a reference of -1 uses the list not, and its vector is read as it
    stands. Neighbours are the blocks left of, above and above right of a
    part; the one above left stands in where the last is missing, lies on the
    right, or belongs to a part that comes later. Beside the median rule, the
    upper and lower halves take the vector above and on the left first if it
    has their reference, left and right halves the one on the left and above
    right. A skipped macroblock has the median of reference 0, or nothing
    where it lies on the edge or a neighbour rests. Differences wrap to 16
    bits; other shapes have no rows.
    """
    shown = with_strips(blocks.select(*keys, "mb_x", "mb_y", "shape", "ref", "x", "y"), keys, ["ref", "x", "y"], list(SIDES))
    grids = shown.select(*keys, "mb_x", "mb_y", "shape", F.col("ref").alias("own_ref"), F.col("x").alias("own_x"), F.col("y").alias("own_y"), _grid("ref", MISSING).alias("r"), _grid("x", 0).alias("gx"), _grid("y", 0).alias("gy"))
    # Which cells a part reads is a table; its rows are a macroblock's parts, and one expression serves them all.
    parts = F.lit(None)
    for shape in SHAPES:
        parts = F.when(F.col("shape") == shape, F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in part.items()]) for part in _cells_read(shape)])).otherwise(parts)
    step = grids.select("*", F.inline(parts))
    cell = lambda grid, at, missing: F.when(F.col(at) >= 0, F.get(grid, F.col(at))).otherwise(missing)
    sides = [cell(grid, at, missing).alias(f"{at}_{grid}") for at in "abcd" for grid, missing in (("r", MISSING), ("gx", 0), ("gy", 0))]
    own = [F.get(f"own_{n}", F.col("own")).cast("int").alias(f"_{n}") for n in ("ref", "x", "y")]
    step = step.select(*keys, "mb_x", "mb_y", "shape", "part", "first", *sides, *own)
    out_of_reach = F.col("c_r") == MISSING
    step = step.withColumns({f"c_{g}": F.when(out_of_reach, F.col(f"d_{g}")).otherwise(F.col(f"c_{g}")) for g in ("r", "gx", "gy")} | {"_ref": F.when(F.col("shape") == "skip", 0).otherwise(F.col("_ref"))})
    refs, vectors = [F.col(f"{at}_r") for at in "abc"], [(F.col(f"{at}_gx"), F.col(f"{at}_gy")) for at in "abc"]
    median = _median_rule(refs, vectors, F.col("_ref"))
    direct = F.get(F.array(*[r == F.col("_ref") for r in refs]), F.col("first")) & (F.col("first") >= 0)  # the side that a half looks at first
    rests = lambda at: (F.col(f"{at}_r") == 0) & (F.col(f"{at}_gx") == 0) & (F.col(f"{at}_gy") == 0)
    still = (F.col("shape") == "skip") & ((refs[0] == MISSING) | (refs[1] == MISSING) | rests("a") | rests("b"))
    pred = [F.when(still, 0).when(F.coalesce(direct, F.lit(False)), F.get(F.array(*[v[axis] for v in vectors]), F.col("first"))).otherwise(median[axis]) for axis in (0, 1)]
    done = step.select(*keys, "mb_x", "mb_y", "part", F.col("_ref").alias("ref"), "_x", "_y", *[p.cast("int").alias(f"pred_{n}") for n, p in zip("xy", pred, strict=True)])
    return done.select(*keys, "mb_x", "mb_y", "part", "ref", "pred_x", "pred_y", *[wrap16(F.col(f"_{n}") - F.col(f"pred_{n}")).cast("int").alias(f"diff_{n}") for n in "xy"])


_ROW = 1 << 33  # places between a macroblock and the one below it: more than any two of a row are apart


def _pair(high: Column, low: Column) -> Column:
    """Two integers as one."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def _apart(pair: Column) -> tuple[Column, Column]:
    return F.shiftright(pair, 32).cast("int"), F.shiftright(F.shiftleft(pair, 32), 32).cast("int")


def _looked_up(rows: DataFrame, keys: list[str], names: dict[str, list[str]]) -> DataFrame:
    """``rows`` with side_name for the names of each side: the neighbour's columns, null where there is none.

    A picture's rows come to one task (without a shuffle, if they lie by ``keys`` already) and are sorted once by place.
    """
    place = F.col("mb_y").cast("int").cast("long") * _ROW + F.col("mb_x").cast("int")
    known = F.col("_place").isNotNull()  # nulls are no place and no picture, though a window takes them for equal
    for k in keys:
        known &= F.col(k).isNotNull()
    at = lambda dx, dy: Window.partitionBy(*keys).orderBy("_place").rangeBetween(dy * _ROW + dx, dy * _ROW + dx)
    seen = [F.when(known, F.first(n).over(at(*SIDES[side][:2]))).alias(f"{side}_{n}") for side, listed in names.items() for n in listed]
    return rows.withColumn("_place", place).select(*rows.columns, *seen)


def spatial_direct(blocks: DataFrame, colocated: DataFrame, keys: list[str], colocated_keys: list[str]) -> DataFrame:
    """Four rows for each direct macroblock, one a quarter: keys, mb_x, mb_y, quarter, still, and ref, x, y of both lists.

    blocks: direct (boolean), colocated_keys (the picture that comes first in
    list 1) and arrays of 16: ref0, x0, y0, ref1, x1, y1. colocated: the same
    arrays of finished pictures under ``keys``, with intra. A list's reference
    is the least one, not negative, of left, above and above right (else above
    left); its vector follows the median rule; without any reference both lists
    have reference 0 and no motion. A quarter is still where its colocated
    block, a corner of the macroblock (the corners of one that is one part are
    alike), has reference 0 (of list 1 where list 0 is not used) and moves by
    at most one quarter sample: then reference 0 has no motion, in each list by
    itself. Intra and missing colocated macroblocks are not still. One picture
    is one task's work; pictures that lie by ``keys`` are not shuffled for it.
    """
    pairs = [("ref0", "ref1"), ("x0", "y0"), ("x1", "y1")]
    # The blocks that neighbours look at: the last of the first row, the first of the last row, and the last of all.
    facing = {"left": 3, "top": 12, "top_right": 12, "top_left": 15}
    value = lambda n, p: F.coalesce(F.get(F.col(n), F.lit(p)).cast("int"), F.lit(MISSING if n in pairs[0] else 0))
    own = [_pair(value(a, p), value(b, p)).alias(f"{a}_{p}") for p in (3, 12, 15) for a, b in pairs]
    held = blocks.select(*keys, "mb_x", "mb_y", *[F.col(c).alias(f"_{c}") for c in colocated_keys], "direct", *own)
    shown = _looked_up(held, keys, {side: [f"{a}_{p}" for a, _ in pairs] for side, p in facing.items()}).where("direct")
    # Without a neighbour both references are MISSING and nothing moves.
    absent = {"ref0": MISSING << 32 | MISSING & 0xFFFFFFFF, "x0": 0, "x1": 0}
    own = [*keys, "mb_x", "mb_y", *[f"_{c}" for c in colocated_keys]]
    step = shown.select(*own, *[F.coalesce(f"{side}_{n}_{p}", F.lit(missing).cast("long")).alias(f"{side}_{n}") for side, p in facing.items() for n, missing in absent.items()])
    right, left = ({n: F.col(f"{side}_{n}") for n in absent} for side in ("top_right", "top_left"))
    gone = [r == MISSING for r in _apart(right["ref0"])]
    refs = _pair(*[F.when(g, v).otherwise(u) for g, u, v in zip(gone, _apart(right["ref0"]), _apart(left["ref0"]), strict=True)])
    step = step.withColumns({"corner_ref0": refs} | {f"corner_x{i}": F.when(gone[i], left[f"x{i}"]).otherwise(right[f"x{i}"]) for i in (0, 1)})
    three = ["left", "top", "corner"]
    step = step.select(*own, *[v.alias(f"{side}_{n}") for side in three for pair in pairs for n, v in zip(pair, _apart(F.col(f"{side}_{pair[0]}")), strict=True)])
    of = lambda n: [F.col(f"{side}_{n}") for side in three]
    step = step.withColumns({f"best{i}": F.least(*[F.when(r >= 0, r) for r in of(f"ref{i}")]) for i in (0, 1)})
    step = step.withColumns({f"whose{i}": F.when(F.col(f"best{i}").isNotNull(), _whose(of(f"ref{i}"), F.col(f"best{i}"))) for i in (0, 1)})
    neither = F.col("best0").isNull() & F.col("best1").isNull()
    ref = {f"ref{i}": F.when(neither, 0).otherwise(F.coalesce(f"best{i}", F.lit(-1))) for i in (0, 1)}
    vector = {f"{n}{i}": F.when(F.col(f"whose{i}") == 3, median3(*of(f"{n}{i}"))).otherwise(F.coalesce(F.get(F.array(*of(f"{n}{i}")), F.col(f"whose{i}")), F.lit(0))).cast("int") for i in (0, 1) for n in "xy"}
    step = step.select(*own, *[v.alias(n) for n, v in (ref | vector).items()])

    # A bit for each corner that rests; list 1 stands in where list 0 is not used.
    used = lambda p: ((r := F.get("ref0", F.lit(p))) == 0, (r < 0) & (F.get("ref1", F.lit(p)) == 0))
    slow = lambda i, p: F.get(f"x{i}", F.lit(p)).isin(-1, 0, 1) & F.get(f"y{i}", F.lit(p)).isin(-1, 0, 1)
    corners = [(used(p), p) for p in (0, 3, 12, 15)]
    bits = sum((F.when((u[0] & slow(0, p)) | (u[1] & slow(1, p)), 1 << k).otherwise(0) for k, (u, p) in enumerate(corners)), F.lit(0))
    # Only places that may hold a still quarter are shipped. As their keys hang on ``intra``, no test for nulls moves below what
    # made ``colocated``: if ``blocks`` was made by the same plan, the two stay alike and it runs once.
    named = dict(zip([*keys, "mb_x", "mb_y"], [*[f"_{c}" for c in colocated_keys], "mb_x", "mb_y"], strict=True))
    there = colocated.where(reduce(or_, [u[0] | u[1] for u, _ in corners])).select(*[F.when(~F.col("intra"), F.col(k)).alias(n) for k, n in named.items()], bits.alias("bits"))
    both = step.join(there.hint("merge"), [*[f"_{c}" for c in colocated_keys], "mb_x", "mb_y"], "left")
    quarters = both.withColumn("quarter", F.explode(F.array(*map(F.lit, range(4))))).withColumn("still", F.coalesce(F.call_function("shiftright", "bits", F.col("quarter")).bitwiseAND(F.lit(1)) != 0, F.lit(False)))
    moved = [F.when(F.col("still") & (F.col(f"ref{i}") == 0), 0).otherwise(F.col(f"{n}{i}")).alias(f"{n}{i}") for i in (0, 1) for n in "xy"]
    return quarters.select(*keys, "mb_x", "mb_y", "quarter", "still", "ref0", "ref1", *moved)
