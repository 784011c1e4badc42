"""Intra and inter sample prediction on numpy planes; what reads reconstructed neighbours runs inside the decoding kernel.

A neighbour that is not available is None. Samples are integers 0..255.
"""

from __future__ import annotations

import numpy as np

VERTICAL, HORIZONTAL, DC = 0, 1, 2


def _dc(sides: list[np.ndarray | None]) -> int:
    """The rounded mean of the sides that are there, 128 without any."""
    there = [s for s in sides if s is not None]
    n = sum(map(len, there))
    return (int(sum(int(s.sum()) for s in there)) + n // 2) // n if n else 128


def filter_edges(left: np.ndarray | None, corner: int | None, top: np.ndarray | None) -> tuple:
    """The reference smoothing of 8x8 intra prediction: (1, 2, 1) along left, corner and top (16 samples)."""

    def smooth(line: np.ndarray, before: int | None) -> np.ndarray:
        first = line[0] if before is None else before
        long = np.concatenate([[first], line, [line[-1]]]).astype(np.int64)
        return (long[:-2] + 2 * long[1:-1] + long[2:] + 2) >> 2

    new_corner = corner
    if corner is not None and (left is not None or top is not None):
        a = corner if left is None else int(left[0])
        b = corner if top is None else int(top[0])
        new_corner = (a + 2 * corner + b + 2) >> 2
    return None if left is None else smooth(left, corner), new_corner, None if top is None else smooth(top, corner)


def intra_square(mode: int, left: np.ndarray | None, corner: int | None, top: np.ndarray | None) -> np.ndarray:
    """One of the nine directional modes of a 4x4 or 8x8 block.

    ``left`` has n samples downwards, ``top`` 2n to the right (the last ones
    repeated where the block to the upper right is missing). With left,
    corner and top as one line E(-n) .. E(0) .. E(2n), every oblique mode is a
    two- or three-tap mean at a place that is linear in x and y.
    """
    n = len(left) if left is not None else len(top) // 2 if top is not None else 4
    if mode == DC:
        return np.full((n, n), _dc([left, None if top is None else top[:n]]), np.int64)
    line = np.zeros(3 * n + 1, np.int64)
    if left is not None:
        line[:n] = left[::-1]
    if corner is not None:
        line[n] = corner
    if top is not None:
        line[n + 1 :] = top
    y, x = np.mgrid[0:n, 0:n]
    at = lambda k: line[np.clip(k + n, 0, 3 * n)]
    two = lambda k: (at(k) + at(k + 1) + 1) >> 1
    three = lambda k: (at(k - 1) + 2 * at(k) + at(k + 1) + 2) >> 2
    if mode == VERTICAL:
        return at(x + 1)
    if mode == HORIZONTAL:
        return at(-y - 1)
    if mode == 3:
        return three(x + y + 2)
    if mode == 4:
        return three(x - y)
    if mode in (5, 6):
        run, k, sign = (2 * x - y, x - (y >> 1), 1) if mode == 5 else (2 * y - x, y - (x >> 1), -1)
        even = two(k) if mode == 5 else two(-k - 1)
        return np.select([(run >= 0) & (run % 2 == 0), run > 0, run == -1], [even, three(sign * k), three(0 * x)], three(sign * (run + 1)))
    if mode == 7:
        k = x + (y >> 1)
        return np.where(y % 2 == 0, two(k + 1), three(k + 2))
    if mode == 8:
        run, k = x + 2 * y, y + (x >> 1)
        return np.select([run > 2 * n - 3, run % 2 == 0], [at(0 * x - n), two(-k - 2)], three(-k - 2))
    raise ValueError(f"intra mode {mode}")


def _plane(left: np.ndarray, corner: int, top: np.ndarray) -> np.ndarray:
    n = len(top)
    half, gain = n // 2, 5 if n == 16 else 34
    weights = np.arange(1, half + 1)

    def slope(side: np.ndarray) -> int:
        line = np.concatenate([[corner], side]).astype(np.int64)
        return (gain * int((weights * (line[half + 1 : n + 1] - line[half - 1 :: -1])).sum()) + 32) >> 6

    y, x = np.mgrid[0:n, 0:n] - (half - 1)
    return np.clip((16 * (int(left[-1]) + int(top[-1])) + slope(top) * x + slope(left) * y + 16) >> 5, 0, 255)


def intra_luma16(mode: int, left: np.ndarray | None, corner: int | None, top: np.ndarray | None) -> np.ndarray:
    """Vertical, horizontal, DC or plane prediction of a 16x16 block."""
    if mode == 3:
        return _plane(left, corner, top)
    if mode == DC:
        return np.full((16, 16), _dc([left, top]), np.int64)
    return np.broadcast_to(top[None, :] if mode == VERTICAL else left[:, None], (16, 16)).astype(np.int64)


def intra_chroma(mode: int, left: np.ndarray | None, corner: int | None, top: np.ndarray | None) -> np.ndarray:
    """DC by quadrant, horizontal, vertical or plane prediction of an 8x8 chroma block."""
    if mode == 3:
        return _plane(left, corner, top)
    if mode in (1, 2):
        return np.broadcast_to(left[:, None] if mode == 1 else top[None, :], (8, 8)).astype(np.int64)
    out = np.empty((8, 8), np.int64)
    for y in (0, 4):
        for x in (0, 4):
            a, b = None if left is None else left[y : y + 4], None if top is None else top[x : x + 4]
            # The two quadrants off the diagonal take the side they touch alone, if it is there.
            if x != y:
                a, b = (None, b) if x and b is not None else (a, None) if y and a is not None else (a, b)
            out[y : y + 4, x : x + 4] = _dc([a, b])
    return out


def predicted_mode(left: int | None, top: int | None) -> int:
    """The smaller of the neighbours' 4x4 or 8x8 modes; DC where one is missing."""
    return DC if left is None or top is None else min(left, top)


def _patch(plane: np.ndarray, y: int, x: int, h: int, w: int) -> np.ndarray:
    """A rectangle of a plane whose edges repeat outwards."""
    rows, cols = np.clip(np.arange(y, y + h), 0, plane.shape[0] - 1), np.clip(np.arange(x, x + w), 0, plane.shape[1] - 1)
    return plane[np.ix_(rows, cols)].astype(np.int64)


def _taps(v: np.ndarray, axis: int) -> np.ndarray:
    n = v.shape[axis] - 5
    a, b, c, d, e, f = (np.take(v, range(i, i + n), axis) for i in range(6))
    return a - 5 * b + 20 * c + 20 * d - 5 * e + f


def inter_luma(plane: np.ndarray, y: int, x: int, h: int, w: int, mv: tuple[int, int]) -> np.ndarray:
    """The block at (y, x) moved by ``mv`` = (x, y) quarter samples, by the six-tap filter."""
    mx, my = mv
    fx, fy = mx & 3, my & 3
    v = _patch(plane, y + (my >> 2) - 2, x + (mx >> 2) - 2, h + 5, w + 5)
    whole = lambda dy, dx: v[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
    rounded = lambda s: np.clip((s + 16) >> 5, 0, 255)
    across = lambda dy: rounded(_taps(v[2 + dy : 2 + dy + h], 1))
    down = lambda dx: rounded(_taps(v[:, 2 + dx : 2 + dx + w], 0))
    mean = lambda a, b: (a + b + 1) >> 1
    if fx == 0 and fy == 0:
        return whole(0, 0)
    if fy == 0:
        return across(0) if fx == 2 else mean(across(0), whole(0, fx // 2))
    if fx == 0:
        return down(0) if fy == 2 else mean(down(0), whole(fy // 2, 0))
    if fx != 2 and fy != 2:
        return mean(across(fy // 2), down(fx // 2))
    centre = np.clip((_taps(_taps(v, 1), 0) + 512) >> 10, 0, 255)
    if fx == 2 and fy == 2:
        return centre
    return mean(centre, across(fy // 2) if fx == 2 else down(fx // 2))


def inter_chroma(plane: np.ndarray, y: int, x: int, h: int, w: int, mv: tuple[int, int]) -> np.ndarray:
    """The chroma block at (y, x) moved by ``mv`` eighths of a sample, bilinear."""
    dx, dy = mv[0] & 7, mv[1] & 7
    v = _patch(plane, y + (mv[1] >> 3), x + (mv[0] >> 3), h + 1, w + 1)
    return ((8 - dx) * (8 - dy) * v[:-1, :-1] + dx * (8 - dy) * v[:-1, 1:] + (8 - dx) * dy * v[1:, :-1] + dx * dy * v[1:, 1:] + 32) >> 6


def add_residual(prediction: np.ndarray, residual: np.ndarray) -> np.ndarray:
    return np.clip(prediction + residual, 0, 255)
