"""Sample and coefficient blocks: array columns for SQL, numpy batches for Python stages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumaframe.functions.scalar import wrap16

#: The zigzag order of a 4x4 block (raster place of each scanned coefficient).
ZIGZAG4 = [0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15]
#: Dequantiser levels by qp % 6 for the even-even, odd-odd and other places of a 4x4 block.
LEVELS4 = [(10, 16, 13), (11, 18, 14), (13, 20, 16), (14, 23, 18), (16, 25, 20), (18, 29, 23)]
#: The same of an 8x8 block, by place class, and the place classes of its top left 4x4 places, which repeat.
LEVELS8 = [(20, 18, 32, 19, 25, 24), (22, 19, 35, 21, 28, 26), (26, 23, 42, 24, 33, 31), (28, 25, 45, 26, 35, 33), (32, 28, 51, 30, 40, 38), (36, 32, 58, 34, 46, 43)]
PLACES8 = [(0, 3, 4, 3), (3, 1, 5, 1), (4, 5, 2, 5), (3, 1, 5, 1)]
#: Quantiser factors by qp % 6 for the even-even, odd-odd and other places of a 4x4 block.
FACTORS4 = [(13107, 5243, 8066), (11916, 4660, 7490), (10082, 4194, 6554), (9362, 3647, 5825), (8192, 3355, 5243), (7282, 2893, 4559)]
HADAMARD = np.array([[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]], np.int64)


def zigzag8() -> list[int]:
    """Raster places along the anti-diagonals of an 8x8 block, turning at each edge."""
    return sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))


def _place4(place: int) -> int:
    row, column = divmod(place, 4)
    even = (row % 2 == 0) + (column % 2 == 0)
    return 0 if even == 2 else 1 if even == 0 else 2


def level4(qp_rem: int, place: int) -> int:
    return LEVELS4[qp_rem][_place4(place)]


def inverse_scan(scanned: Column, order: list[int] = ZIGZAG4) -> Column:
    """Scanned coefficients put in raster order."""
    return F.array(*[F.get(scanned, F.lit(order.index(p))) for p in range(len(order))])


def _by_rest(table: list[list[int]], qp: Column) -> Column:
    return F.get(F.array(*[F.array(*map(F.lit, row)) for row in table]), (qp % 6).cast("int"))


def _doubled(qp: Column) -> Column:
    """2 to the power of qp / 6, for qp 0 to 51."""
    return F.get(F.array(*[F.lit(1 << n) for n in range(9)]), F.floor(qp / 6).cast("int")).cast("long")


def dequant4x4(block: Column, qp: Column, *, ac_only: bool = False, wrap: bool = False) -> Column:
    """Raster coefficients times their level, shifted by qp / 6; ``ac_only`` leaves the first as it is, ``wrap`` keeps 16 bits."""
    levels = _by_rest([[level4(r, p) for p in range(16)] for r in range(6)], qp)
    whole = wrap16 if wrap else lambda x: x
    scaled = _bound(_doubled(qp), lambda d: F.zip_with(block, levels, lambda c, v: whole(c.cast("long") * v * d)))
    return F.concat(F.array(F.get(block, F.lit(0)).cast("long")), F.slice(scaled, 2, 15)) if ac_only else scaled


def dequant8x8(block: Column, qp: Column, *, wrap: bool = False) -> Column:
    """The same for a raster 8x8 block, a quarter of the product truncated toward zero."""
    levels = _by_rest([[LEVELS8[r][PLACES8[p // 8 % 4][p % 4]] for p in range(64)] for r in range(6)], qp)
    quarter = lambda x: (F.signum(x) * F.floor(F.abs(x) / 4)).cast("long")
    whole = wrap16 if wrap else lambda x: x
    return _bound(_doubled(qp), lambda d: F.zip_with(block, levels, lambda c, v: whole(quarter(c.cast("long") * v * d))))


def quant4x4(block: Column, qp: Column) -> Column:
    """Raster coefficients times their factor, shifted by 15 + qp / 6 after a third is added; signs are kept."""
    factors = _by_rest([[FACTORS4[r][_place4(p)] for p in range(16)] for r in range(6)], qp)

    def scaled(bits: Column) -> Column:
        size = lambda c, f: F.floor((F.abs(c.cast("long")) * f + F.floor(bits / 3)) / bits)
        return F.zip_with(block, factors, lambda c, f: (F.signum(c) * size(c, f)).cast("long"))

    return _bound(_doubled(qp) * 32768, scaled)


def _combine(block: Column, rows: list[list[tuple[int, int]]]) -> Column:
    """Each output as a sum of (sign, place) inputs."""
    return F.array(*[sum((F.get(block, F.lit(p)) * s for s, p in row[1:]), F.get(block, F.lit(row[0][1])) * row[0][0]) for row in rows])


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: a one-element transform binds it to a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hadamard4x4(block: Column) -> Column:
    """H x H of a raster 4x4 block, without scaling."""
    across = [[(int(HADAMARD[c, k]), 4 * r + k) for k in range(4)] for r in range(4) for c in range(4)]
    down = [[(int(HADAMARD[r, k]), 4 * k + c) for k in range(4)] for r in range(4) for c in range(4)]
    return _bound(block, lambda x: _bound(_combine(x, across), lambda y: _combine(y, down)))


def hadamard2x2(block: Column) -> Column:
    signs = [(1, 1, 1, 1), (1, -1, 1, -1), (1, 1, -1, -1), (1, -1, -1, 1)]
    return _combine(block, [[(s, p) for p, s in enumerate(row)] for row in signs])


def luma_dc(block: Column, qp: Column) -> Column:
    """The sixteen first coefficients of a 16x16 intra macroblock: H x H, then the first place's level, rounded to a quarter below qp 12."""
    level = F.get(F.array(*[F.lit(x[0]) for x in LEVELS4]), (qp % 6).cast("int"))

    def scaled(d: Column) -> Column:
        # Below 12 the shift is to the right by 2 - qp / 6, with rounding; from 12 on to the left.
        return F.transform(hadamard4x4(block), lambda c: F.floor((c * level * d + F.when(qp < 12, 2).otherwise(0)) / 4).cast("long"))

    return _bound(_doubled(qp), scaled)


def chroma_dc(block: Column, qp: Column) -> Column:
    """The four first coefficients of a chroma plane: 2x2 Hadamard, then the first place's level, halved and rounded down."""
    level = F.get(F.array(*[F.lit(x[0]) for x in LEVELS4]), (qp % 6).cast("int"))
    return _bound(_doubled(qp), lambda d: F.transform(hadamard2x2(block), lambda c: F.floor(c * level * d / 2).cast("long")))


def dct4x4(block: Column) -> Column:
    """Forward 4x4 transform of a raster block."""
    basis = [[1, 1, 1, 1], [2, 1, -1, -2], [1, -1, -1, 1], [1, -2, 2, -1]]
    across = [[(basis[c][k], 4 * r + k) for k in range(4)] for r in range(4) for c in range(4)]
    down = [[(basis[r][k], 4 * k + c) for k in range(4)] for r in range(4) for c in range(4)]
    return _bound(block, lambda x: _bound(_combine(x, across), lambda y: _combine(y, down)))


def _forward8(line: Column) -> Column:
    """Eight samples transformed: sums of mirrored pairs give the even places, differences the odd ones; halves and quarters are rounded down."""
    at = lambda i: F.get(line, F.lit(i)).cast("long")
    pairs = F.struct(*[(at(i) + at(7 - i)).alias(f"s{i}") for i in range(4)], *[(at(i) - at(7 - i)).alias(f"d{i}") for i in range(4)])

    def places(p: Column) -> Column:
        outer, inner, slope, bend = p["s0"] + p["s3"], p["s1"] + p["s2"], p["s0"] - p["s3"], p["s1"] - p["s2"]
        half = lambda v, bits=1: F.shiftright(v, bits)
        rise, fall, both, turn = p["d0"] + half(p["d3"]), p["d0"] - half(p["d3"]), p["d1"] + p["d2"], p["d2"] - p["d1"]
        return F.array(outer + inner, rise + both + half(rise, 2), slope + half(bend), fall + turn + half(turn, 2), outer - inner, fall - turn - half(turn, 2), half(slope) - bend, both - rise - half(rise, 2))

    return _bound(pairs, places)


def dct8x8(block: Column) -> Column:
    """Forward 8x8 transform of a raster block: its lines, then its columns."""
    turned = lambda x: F.array(*[F.array(*[F.get(F.get(x, F.lit(r)), F.lit(c)) for r in range(8)]) for c in range(8)])
    lines = F.array(*[F.slice(block, 8 * r + 1, 8) for r in range(8)])
    across = F.transform(lines, _forward8)
    return _bound(across, lambda x: _bound(F.transform(turned(x), _forward8), lambda y: F.flatten(turned(y))))


def inverse_where(blocks: Column, mask: Column, inverse: Callable[[Column], Column] | None = None) -> Column:
    """Each block of an array whose bit is set in the mask, transformed; the others as they are."""
    inverse = inverse or idct4x4_column
    return F.transform(blocks, lambda b, i: F.when(F.call_function("shiftright", mask.cast("long"), i).bitwiseAND(F.lit(1)) != 0, inverse(b)).otherwise(b))


def sad(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def satd4x4(a: Column, b: Column) -> Column:
    """Half the sum of absolute Hadamard coefficients of the difference, rounded up."""
    moved = hadamard4x4(F.zip_with(a, b, lambda x, y: (x - y).cast("long")))
    return F.shiftright(F.aggregate(moved, F.lit(0).cast("long"), lambda s, x: s + F.abs(x)) + 1, 1)


def idct4x4(x: np.ndarray) -> np.ndarray:
    """Inverse 4x4 transform of (n, 4, 4) coefficients, rounded by 64ths."""
    x = x.astype(np.int64)
    for axis in (2, 1):
        a, b, c, d = (np.take(x, i, axis) for i in range(4))
        even, odd = (a + c, a - c), (b + (d >> 1), (b >> 1) - d)
        x = np.stack([even[0] + odd[0], even[1] + odd[1], even[1] - odd[1], even[0] - odd[0]], axis)
    return (x + 32) >> 6


def idct8x8(x: np.ndarray) -> np.ndarray:
    """Inverse 8x8 transform of (n, 8, 8) coefficients, rounded by 64ths."""
    x = x.astype(np.int64)
    for axis in (2, 1):
        v = [np.take(x, i, axis) for i in range(8)]
        e = [v[0] + v[4], v[0] - v[4], (v[2] >> 1) - v[6], v[2] + (v[6] >> 1)]
        f = [e[0] + e[3], e[1] + e[2], e[1] - e[2], e[0] - e[3]]
        o = [v[5] - v[3] - v[7] - (v[7] >> 1), v[1] + v[7] - v[3] - (v[3] >> 1), v[7] - v[1] + v[5] + (v[5] >> 1), v[3] + v[5] + v[1] + (v[1] >> 1)]
        g = [o[0] + (o[3] >> 2), o[1] + (o[2] >> 2), (o[1] >> 2) - o[2], o[3] - (o[0] >> 2)]
        x = np.stack([f[0] + g[3], f[1] + g[2], f[2] + g[1], f[3] + g[0], f[3] - g[0], f[2] - g[1], f[1] - g[2], f[0] - g[3]], axis)
    return (x + 32) >> 6


def idct4x4_column(block: Column) -> Column:
    """The same for a raster array column."""

    def lines(x: Column, at) -> list[Column]:
        out: list = [None] * 16
        for n in range(4):
            a, b, c, d = (F.get(x, F.lit(at(n, k))).cast("long") for k in range(4))
            half = lambda v: F.shiftright(v, 1)
            sums = [a + c + b + half(d), a - c + half(b) - d, a - c - half(b) + d, a + c - b - half(d)]
            for k in range(4):
                out[at(n, k)] = sums[k]
        return out

    once = F.array(*lines(block, lambda n, k: 4 * n + k))
    # A one-element transform binds the half-way block to a variable, so that it is computed once.
    done = F.transform(F.array(once), lambda y: F.array(*[F.shiftright(v + 32, 6) for v in lines(y, lambda n, k: 4 * k + n)]))
    return F.get(done, F.lit(0))


def idct8x8_column(block: Column) -> Column:
    """Inverse 8x8 transform of a raster array column, rounded by 64ths: each line is bound once, so work is linear."""
    half = lambda v, n=1: F.shiftright(v, n)

    def line(values: Column) -> Column:
        v = [F.get(values, F.lit(i)).cast("long") for i in range(8)]
        even = F.array(v[0] + v[4], v[0] - v[4], half(v[2]) - v[6], v[2] + half(v[6]))
        odd = F.array(v[5] - v[3] - v[7] - half(v[7]), v[1] + v[7] - v[3] - half(v[3]), v[7] - v[1] + v[5] + half(v[5]), v[3] + v[5] + v[1] + half(v[1]))

        def joined(both: Column) -> Column:
            e, o = ([F.get(both[i], F.lit(k)) for k in range(4)] for i in (0, 1))
            f = [e[0] + e[3], e[1] + e[2], e[1] - e[2], e[0] - e[3]]
            g = [o[0] + half(o[3], 2), o[1] + half(o[2], 2), half(o[1], 2) - o[2], o[3] - half(o[0], 2)]
            return F.array(f[0] + g[3], f[1] + g[2], f[2] + g[1], f[3] + g[0], f[3] - g[0], f[2] - g[1], f[1] - g[2], f[0] - g[3])

        return _bound(F.array(even, odd), joined)

    def columns(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: line(F.transform(rows, lambda r: F.get(r, c))))

    across = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: line(F.slice(block, r * 8 + 1, F.lit(8))))
    down = _bound(across, columns)  # its rows are the block's columns
    return _bound(down, lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: half(F.get(F.get(d, p % 8), F.floor(p / 8).cast("int")) + 32, 6)))
