"""Macroblock syntax tables and rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coded block patterns by code number, for intra 4x4 and 8x8 macroblocks and for inter ones (4:2:0).
CBP_INTRA = [47, 31, 15, 0, 23, 27, 29, 30, 7, 11, 13, 14, 39, 43, 45, 46, 16, 3, 5, 10, 12, 19, 21, 26, 28, 35, 37, 42, 44, 1, 2, 4, 8, 17, 18, 20, 24, 6, 9, 22, 25, 32, 33, 34, 36, 40, 38, 41]
CBP_INTER = [0, 16, 1, 2, 4, 8, 32, 3, 5, 10, 12, 15, 47, 7, 11, 13, 14, 6, 9, 31, 35, 37, 42, 44, 33, 34, 36, 40, 39, 43, 45, 46, 17, 18, 20, 24, 19, 21, 26, 28, 23, 27, 29, 30, 22, 25, 38, 41]
#: Lists that the two partitions of B macroblock types 4 to 21 use, a pair of types (16x8, 8x16) each.
B_PAIRS = ["L0 L0", "L1 L1", "L0 L1", "L1 L0", "L0 Bi", "L1 Bi", "Bi L0", "Bi L1", "Bi Bi"]
#: Lists that B sub-macroblock types 0 to 12 use (0 is direct) and their numbers of partitions.
B_SUB = ["", "L0", "L1", "Bi", "L0", "L0", "L1", "L1", "Bi", "Bi", "L0", "L1", "Bi"]
B_SUB_PARTS = [1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 4, 4, 4]
#: Flag sets that stand for direct quarters, as direct-mode rows and as motion-cache rows show them.
DIRECT_FLAGS = [12552, 20744, 61704]
DIRECT_CELLS = [12552, 20744, 61704, 49416]
#: Bits of a macroblock's flag set: shapes, direct, and the use of each list by each partition.
SHAPE_16X16, SHAPE_16X8, SHAPE_8X16, SHAPE_8X8, DIRECT2 = 1 << 3, 1 << 4, 1 << 5, 1 << 6, 1 << 8
USE = {(0, 0): 1 << 12, (0, 1): 1 << 13, (1, 0): 1 << 14, (1, 1): 1 << 15}  # (list, partition)


def _table(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def coded_block_pattern(code: Column, intra: Column) -> Column:
    """The pattern of a code number; 0 beyond the table."""
    return F.coalesce(F.when(intra, _table(CBP_INTRA, code)).otherwise(_table(CBP_INTER, code)), F.lit(0))


def b_lists(mb_type: int) -> tuple[str, str]:
    """What the partitions of a B macroblock type use: L0, L1, Bi or nothing."""
    if mb_type in (0, 22):
        return "Bi", "Bi"
    if mb_type in (1, 2, 3):
        return ("L0", "L1", "Bi")[mb_type - 1], ""
    return tuple(B_PAIRS[(mb_type - 4) // 2].split(" ")) if 4 <= mb_type <= 21 else ("", "")


def _has(lists: str, which: int) -> bool:
    return lists in (f"L{which}", "Bi")


def b_uses(mb_type: Column, which: int, part: int) -> Column:
    """Whether a partition of a B macroblock uses a list, by the type's number; direct and 8x8 count as both."""
    return F.coalesce(_table([_has(b_lists(t)[part], which) for t in range(23)], mb_type), F.lit(False))


def b_sub_uses(sub_type: Column, which: int) -> Column:
    return F.coalesce(_table([_has(s, which) for s in B_SUB], sub_type), F.lit(False))


def b_sub_parts(sub_type: Column) -> Column:
    return _table(B_SUB_PARTS, sub_type)


def _quarter_uses(sub: Column, which: int, part: int) -> Column:
    return F.get(sub, F.lit(min(part, 3))).cast("int").bitwiseAND(USE[which, 0] | USE[which, 1]) != 0


def number_uses(mb_type: Column, sub: Column, which: int, part: int) -> Column:
    """List use of a partition from the type's number; 8x8 types go by their quarter's flags, whole ones by their only partition."""
    first, second = b_uses(mb_type, which, 0), b_uses(mb_type, which, 1)
    return F.when(mb_type == 22, _quarter_uses(sub, which, part)).otherwise(first if part == 0 else F.when((mb_type <= 3) & F.lit(part == 1), first).otherwise(second))


def flags_use(flags: Column, sub: Column, which: int, part: int) -> Column:
    """The same from a macroblock's flag set."""
    bit = lambda p: flags.cast("int").bitwiseAND(USE[which, p]) != 0
    whole = flags.cast("int").bitwiseAND(SHAPE_16X16) != 0
    plain = bit(0) if part == 0 else F.when(whole & F.lit(part == 1), bit(0)).otherwise(bit(1))
    return F.when(flags.cast("int").bitwiseAND(SHAPE_8X8) != 0, _quarter_uses(sub, which, part)).otherwise(plain)


def b_type_flags(mb_type: Column, sub_types: Column) -> Column:
    """The flag set of a B macroblock: its shape, direct, and the lists that its partitions (columns of quarters, for 8x8) use."""

    def flags(t: int) -> int:
        shape = SHAPE_16X16 if t < 4 else SHAPE_8X16 if t % 2 else SHAPE_16X8
        whole = t in (1, 2, 3)
        used = sum(bit for (which, part), bit in USE.items() if _has(b_lists(t)[part], which) and not (whole and part))
        return shape | used | (DIRECT2 if t == 0 else 0)

    def quarter(s: Column, i: Column) -> Column:
        part = lambda which: F.when(i % 2 == 0, F.lit(USE[which, 0])).otherwise(F.lit(USE[which, 1]))
        used = F.when(b_sub_uses(s, 0), part(0)).otherwise(0).bitwiseOR(F.when(b_sub_uses(s, 1), part(1)).otherwise(0))
        return F.when(s == 0, F.lit(DIRECT2 | sum(USE.values()))).otherwise(used)

    eighths = F.aggregate(F.transform(sub_types, quarter), F.lit(SHAPE_8X8), lambda a, x: a.bitwiseOR(x))
    return F.when(mb_type == 22, eighths).otherwise(_table([flags(t) for t in range(22)], mb_type))


def p_type_flags(mb_type: Column) -> Column:
    """The flag set of a P macroblock: its shape and list 0 for both partitions; types from 5 on are intra 4x4."""
    shapes = [SHAPE_16X16, SHAPE_16X8, SHAPE_8X16, SHAPE_8X8, SHAPE_8X8]
    return F.when(mb_type >= 5, 1).otherwise(_table([s | USE[0, 0] | USE[0, 1] for s in shapes], mb_type))


def transform8x8_flag_present(enabled: Column, cbp: Column, p_8x8: Column, b_type: Column, sub_types: Column, inference: Column) -> Column:
    """Whether an inter macroblock carries the 8x8-transform flag: luma is coded and nothing is split below 8x8.

    ``b_type`` is null for P macroblocks; ``p_8x8`` says that a P macroblock is split in quarters.
    """
    luma = cbp.cast("int").bitwiseAND(15) != 0
    p_split = F.coalesce(p_8x8, F.lit(False)) & F.exists(sub_types, lambda s: s != 0)
    b_split = (b_type == 22) & F.exists(sub_types, lambda s: (s >= 4) | ((s == 0) & ~inference))
    b_direct = (b_type == 0) & ~inference
    return enabled & luma & ~p_split & ~F.coalesce(b_split | b_direct, F.lit(False))


def block_place(index: int) -> tuple[int, int]:
    """Row and column, in 4x4 blocks, of a luma block in coding order: quarters, and blocks inside them, go in Z order."""
    return 2 * (index >> 3) + (index >> 1 & 1), 2 * (index >> 2 & 1) + (index & 1)


def coding_to_raster(blocks: Column) -> Column:
    """Sixteen values in coding order put in raster order."""
    order = [4 * r + c for r, c in map(block_place, range(16))]
    return F.array(*[F.get(blocks, F.lit(order.index(p))) for p in range(16)])


def split8x8(block: Column) -> Column:
    """A raster 8x8 block as its four raster 4x4 blocks, in Z order."""
    return F.array(*[F.array(*[F.get(block, F.lit((4 * (q >> 1) + y) * 8 + 4 * (q & 1) + x)) for y in range(4) for x in range(4)]) for q in range(4)])


def join8x8(blocks: Column) -> Column:
    """Four raster 4x4 blocks, in Z order, as one raster 8x8 block."""
    return F.array(*[F.get(F.get(blocks, F.lit(2 * (y >> 2) + (x >> 2))), F.lit((y & 3) * 4 + (x & 3))) for y in range(8) for x in range(8)])
