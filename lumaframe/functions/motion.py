"""Motion-vector prediction from neighbouring partitions.

A neighbour is (ref, (x, y)), or None where it is outside the picture or
slice; ref -1 marks an intra block or an unused list.
"""

from __future__ import annotations

Vector = tuple[int, int]
Neighbour = tuple[int, Vector] | None

ZERO: Vector = (0, 0)


def _middle(a: int, b: int, c: int) -> int:
    return sorted((a, b, c))[1]


def _held(n: Neighbour) -> tuple[int, Vector]:
    return (-1, ZERO) if n is None or n[0] < 0 else n


def predict(ref: int, left: Neighbour, top: Neighbour, corner: Neighbour) -> Vector:
    """The median of three; a single neighbour of the same reference alone; the left one where neither other exists."""
    if top is None and corner is None and left is not None:
        return _held(left)[1]
    three = [_held(n) for n in (left, top, corner)]
    same = [mv for r, mv in three if r == ref]
    if len(same) == 1:
        return same[0]
    return _middle(*(mv[0] for _, mv in three)), _middle(*(mv[1] for _, mv in three))


def predict_half(ref: int, shape: str, part: int, left: Neighbour, top: Neighbour, corner: Neighbour) -> Vector:
    """16x8 prefers the top (first half) or left neighbour, 8x16 the left or upper-right one, if its reference is the same."""
    first = {("16x8", 0): top, ("16x8", 1): left, ("8x16", 0): left, ("8x16", 1): corner}[shape, part]
    return first[1] if first is not None and first[0] == ref else predict(ref, left, top, corner)


def predict_skip(left: Neighbour, top: Neighbour, corner: Neighbour) -> Vector:
    """Zero at the picture's edge and beside a resting block of reference 0, else the prediction of reference 0."""
    if left is None or top is None or (0, ZERO) in (left, top):
        return ZERO
    return predict(0, left, top, corner)


def direct_refs(neighbours: list[tuple[Neighbour, Neighbour, Neighbour]]) -> tuple[int, int]:
    """Spatial direct: each list's smallest reference in use; (0, 0) where neither list has one."""
    found = [min((n[0] for n in three if n is not None and n[0] >= 0), default=-1) for three in neighbours]
    return (0, 0) if found[0] < 0 and found[1] < 0 else (found[0], found[1])


def colocated_zero(ref: int, mv: Vector) -> bool:
    """Whether the colocated block rests: reference 0 and at most a quarter sample in each direction."""
    return ref == 0 and -1 <= mv[0] <= 1 and -1 <= mv[1] <= 1


def _toward_zero(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def temporal_scale(current: int, before: int, after: int) -> int:
    """The factor of 256 by which a colocated vector shrinks, from picture orders; 256 without a distance."""
    tb, td = max(-128, min(127, current - before)), max(-128, min(127, after - before))
    if td == 0:
        return 256
    return max(-1024, min(1023, (tb * _toward_zero(16384 + abs(_toward_zero(td, 2)), td) + 32) >> 6))


def temporal_vectors(mv: Vector, scale: int) -> tuple[Vector, Vector]:
    """Temporal direct: both lists' vectors from the colocated one."""
    first = tuple((scale * v + 128) >> 8 for v in mv)
    return first, tuple(a - b for a, b in zip(first, mv, strict=True))
