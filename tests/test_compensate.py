"""Compensated blocks against a definition of each sample by itself, at all phases and picture edges."""

import numpy as np
import pytest

from lumaframe.operators import compensate as mc

RNG = np.random.default_rng(12)


def sample_at(plane, x, y):
    return int(plane[min(max(y, 0), plane.shape[0] - 1), min(max(x, 0), plane.shape[1] - 1)])


def quarter(plane, x, y):
    """The luma value at x, y in quarter samples: whole, half or the mean of the two nearest of them."""
    six = lambda v: v[0] - 5 * v[1] + 20 * v[2] + 20 * v[3] - 5 * v[4] + v[5]
    clip = lambda v: min(max(v, 0), 255)

    def half(hx, hy):  # in half samples
        ix, iy = hx >> 1, hy >> 1
        row = lambda k: six([sample_at(plane, ix + d, iy + k) for d in range(-2, 4)])
        if not hx & 1 and not hy & 1:
            return sample_at(plane, ix, iy)
        if not hy & 1:
            return clip((row(0) + 16) >> 5)
        if not hx & 1:
            return clip((six([sample_at(plane, ix, iy + d) for d in range(-2, 4)]) + 16) >> 5)
        return clip((six([row(d) for d in range(-2, 4)]) + 512) >> 10)

    if not x & 1 and not y & 1:
        return half(x >> 1, y >> 1)
    if not y & 1:
        ends = [(x - 1, y), (x + 1, y)]
    elif not x & 1:
        ends = [(x, y - 1), (x, y + 1)]
    else:  # the half samples on the diagonal that is not the whole samples' own
        fx, fy = x & 3, y & 3
        ends = [((x & ~3) + 2, (y & ~3) + (4 if fy == 3 else 0)), ((x & ~3) + (4 if fx == 3 else 0), (y & ~3) + 2)]
    a, b = (half(p >> 1, q >> 1) for p, q in ends)
    return (a + b + 1) >> 1


def eighth(plane, x, y):
    fx, fy, ix, iy = x & 7, y & 7, x >> 3, y >> 3
    return ((8 - fx) * (8 - fy) * sample_at(plane, ix, iy) + fx * (8 - fy) * sample_at(plane, ix + 1, iy) + (8 - fx) * fy * sample_at(plane, ix, iy + 1) + fx * fy * sample_at(plane, ix + 1, iy + 1) + 32) >> 6


@pytest.mark.parametrize("width, height", [(150, 90), (17, 5), (64, 64)])
def test_every_phase_and_edge(spark, width, height):
    sizes = {"Y": (width, height), "U": ((width + 1) // 2, (height + 1) // 2)}
    made = {(s, f, p): RNG.integers(0, 256, (h, w), dtype=np.uint8) for s in ("a", "b") for f in range(2) for p, (w, h) in sizes.items()}
    planes = spark.createDataFrame([(s, f, p, v.shape[1], v.shape[0], bytearray(v.tobytes())) for (s, f, p), v in made.items()], "s string, frame int, plane string, width int, height int, data binary")
    rows = []
    for n in range(160):
        p = "Y" if n % 2 == 0 else "U"
        w, h = sizes[p]
        bw, bh = [(16, 16), (8, 4), (4, 4), (16, 8)][n % 4]
        far = 4 if n % 5 else 900
        rows.append((n, "ab"[n % 3 % 2], n % 2, p, int(RNG.integers(0, w)), int(RNG.integers(0, h)), bw, bh, int(RNG.integers(-far * 9, far * 9)) * 4 + n // 2 % 4, int(RNG.integers(-far * 9, far * 9)) * 4 + n // 8 % 4, w, h))
    rows.append((999, "a", 7, "Y", 0, 0, 4, 4, 0, 0, *sizes["Y"]))
    blocks = spark.createDataFrame(rows, "n int, s string, frame int, plane string, x int, y int, w int, h int, mvx int, mvy int, width int, height int").repartition(4)
    found = mc.compensate(blocks, planes, ["s", "frame"])
    assert found.columns == [*blocks.columns, "predicted"]
    got = {r.n: r for r in found.collect()}
    assert len(got) == 161 and got[999].predicted is None
    assert {(r[8] & 3, r[9] & 3) for r in rows if r[3] == "Y"} == {(i, j) for i in range(4) for j in range(4)}
    for n, s, frame, p, x, y, w, h, mvx, mvy, *_ in rows[:-1]:
        plane, value, unit = made[s, frame, p], quarter if p == "Y" else eighth, 4 if p == "Y" else 8
        want = [value(plane, unit * (x + i) + mvx, unit * (y + j) + mvy) for j in range(h) for i in range(w)]
        assert list(got[n].predicted) == want, (n, p, mvx & 3, mvy & 3)


def test_tiles_cover_planes_and_hold_no_more_than_they_need(spark):
    plane = RNG.integers(0, 256, (130, 200), dtype=np.uint8)
    frame = spark.createDataFrame([("k", "Y", 200, 130, bytearray(plane.tobytes())), ("k", "U", 0, 0, bytearray(b"")), ("k", "V", 4, 4, None)], "s string, plane string, width int, height int, data binary")
    tiles = {(r.tile_x, r.tile_y): np.frombuffer(r.tile, np.uint8) for r in mc.plane_tiles(frame, ["s"]).collect()}
    assert set(tiles) == {(x, y) for x in range(4) for y in range(3)} and max(map(len, tiles.values())) == 84 * 84
    assert (tiles[1, 1].reshape(-1, 84) == plane[64:148, 64:148]).all()
