"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_rng = np.random.Generator(np.random.PCG64(20240607))
#: Tabulation hashing: one random word for each (position in a stretch of a word, byte); stretches have odd factors of their own.
_POSITIONS = 128
_TABLE = _rng.integers(0, 2**64, (_POSITIONS, 256), dtype=np.uint64)
_ODD = _rng.integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once, so that a worker's memory does not follow the batch size.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about SLICE_BYTES of text, or single longer rows."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, A-Z lowered, and each text's number of words. A null text has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    bounds = offsets - offsets[0]
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    origin = np.zeros(len(raw), np.int64)
    origin[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(origin)
    values = _TABLE[place & (_POSITIONS - 1), raw]
    far = np.flatnonzero(place >= _POSITIONS)
    values[far] *= mix((place[far] // _POSITIONS).astype(np.uint64), 4) | _U(1)
    values[~solid] = 0
    sums = np.add.reduceat(values, starts)
    lengths = np.add.reduceat(solid, starts, dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, bounds))
    return mix(sums, 1) ^ mix(lengths.astype(np.uint64), 2), counts


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``width`` words, or the whole text where it has fewer."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width if len(rolled) else 0):
        rolled += words[j : len(words) - width + 1 + j] * _ODD[j]
    rolled = mix(rolled, 3)
    sets = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        at = end - n
        if n >= width:
            sets.append(np.unique(rolled[at : end - width + 1]))
        elif n:
            sets.append(mix((words[at:end] * _ODD[:n]).sum(dtype=np.uint64, keepdims=True), 10 + n))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` registers for each set.

    Every element draws one rank for each step and walks a permutation of the
    registers that grows by one Fisher-Yates swap a step, so the ranks of one
    element are correlated: it offers each register a different step. All
    elements take step ``j`` together; a set stops as soon as its registers
    are all filled, since later steps only offer larger values. A register
    holds the step in its top byte and the rank below it.
    """
    registers = np.full((len(sets), size), _MAX)
    flat = registers.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order: np.ndarray | None = None
    rows = np.arange(len(element))
    for step in range(size):
        if not len(element):
            break
        draw = mix(element, 100 + step)
        swap = step + (((mix(draw, 7) >> _U(32)) * _U(size - step)) >> _U(32)).astype(np.int64)
        if step == 0:
            register = swap
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(element), 1))
                order[rows, first_swap] = 0
                order[:, 0] = first_swap
            register = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[:, step]
        np.minimum.at(flat, owner * size + register, (_U(step) << _U(56)) | (draw >> _U(8)))
        unfilled = (registers == _MAX).any(axis=1)
        live = unfilled[owner]
        if not live.all():
            element, owner = element[live], owner[live]
            order = order[live] if order is not None else None
            swap = swap[live]
            rows = np.arange(len(element))
        if step == 0:
            first_swap = swap
    return registers
