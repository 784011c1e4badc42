"""Pictures from slices: one ordered kernel call for each group of pictures, which an IDR picture makes independent.

Decoded: CAVLC I and P slices of one slice a picture, whose macroblocks are
I_PCM, intra 4x4, 8x8 or 16x16, or inter with any partition, as long as no
residual coefficients are coded. Anything else ends its group of pictures
with a row that has a status and no samples. Residuals, CABAC and B slices
are not decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import deblock, motion, prediction
from lumaframe.sources.annexb import Bits, parse_slice_header, resolve_slices

PLANES = "stream_id string, gop long, decode_idx long, nal_idx long, is_idr boolean, frame_num long, full_poc long, plane string, width int, height int, data binary, status string"
#: Coded block pattern "nothing" as its exp-Golomb code, intra and inter.
EMPTY_INTRA, EMPTY_INTER = 3, 0
#: Fixed values: (height, width) in 4x4 blocks of the parts of an 8x8 block by its sub type.
SUB_PARTS = {0: (2, 2), 1: (1, 2), 2: (2, 1), 3: (1, 1)}


class Unsupported(Exception):
    pass


class Picture:
    """Planes padded to whole macroblocks, and what later blocks and pictures need of each 4x4 block."""

    def __init__(self, number: int, sps: dict, header: dict):
        self.number, self.header = number, header
        h, w = sps["mbs_high"], sps["mbs_wide"]
        self.planes = [np.full((16 * h, 16 * w), 128, np.int64), np.full((8 * h, 8 * w), 128, np.int64), np.full((8 * h, 8 * w), 128, np.int64)]
        #: Reference index of each 4x4 block: -2 not decoded yet, -1 intra.
        self.ref = np.full((4 * h, 4 * w), -2, np.int64)
        self.used = np.full((4 * h, 4 * w), -1, np.int64)
        self.mv = np.zeros((4 * h, 4 * w, 2), np.int64)
        self.mode = np.full((4 * h, 4 * w), prediction.DC, np.int64)
        self.coefficients = np.zeros((4 * h, 4 * w), np.int64)
        self.qp, self.large = np.zeros((h, w), np.int64), np.zeros((h, w), bool)

    def neighbour(self, y: int, x: int) -> motion.Neighbour:
        if y < 0 or x < 0 or x >= self.ref.shape[1] or self.ref[y, x] == -2:
            return None
        return int(self.ref[y, x]), (int(self.mv[y, x, 0]), int(self.mv[y, x, 1]))


class SliceDecoder:
    """One slice's macroblocks in raster order."""

    def __init__(self, bits: Bits, header: dict, sps: dict, pps: dict, picture: Picture, refs: list[Picture]):
        self.bits, self.header, self.sps, self.pps, self.pic, self.refs = bits, header, sps, pps, picture, refs
        self.qp = header["qp"]
        self.inter = header["slice_type"] == 0
        self.weights = {w["ref"]: w["values"] for w in header["weights"]} if pps["weighted_pred"] else {}

    def run(self) -> None:
        total, at = self.sps["mbs_wide"] * self.sps["mbs_high"], 0
        while at < total:
            if self.inter:
                run = self.bits.ue()
                for at in range(at, min(total, at + run)):  # noqa: B020
                    self.skipped(*divmod(at, self.sps["mbs_wide"]))
                at += run > 0
                if at >= total or not self.bits.more_data():
                    break
            self.macroblock(*divmod(at, self.sps["mbs_wide"]))
            at += 1
            if not self.bits.more_data():
                break
        if at < total:
            raise Unsupported("slice ends before the picture")

    def macroblock(self, my: int, mx: int) -> None:
        kind = self.bits.ue()
        self.pic.qp[my, mx] = self.qp
        if self.inter and kind < 5:
            self.inter_macroblock(my, mx, kind)
            return
        kind -= 5 * self.inter
        if kind == 25:
            self.raw(my, mx)
        elif kind == 0:
            self.intra_blocks(my, mx)
        elif kind < 25:
            self.intra_whole(my, mx, kind - 1)
        else:
            raise Unsupported(f"macroblock type {kind}")

    def raw(self, my: int, mx: int) -> None:
        self.bits.align()
        for plane, n in zip(self.pic.planes, (16, 8, 8), strict=True):
            block = np.frombuffer(self.bits.u(8 * n * n).to_bytes(n * n), np.uint8)
            plane[n * my : n * my + n, n * mx : n * mx + n] = block.reshape(n, n)
        here = np.s_[4 * my : 4 * my + 4, 4 * mx : 4 * mx + 4]
        self.pic.ref[here], self.pic.coefficients[here] = -1, 16
        self.pic.qp[my, mx] = 0

    # Intra

    def _readable(self, y4: int, x4: int) -> bool:
        ref = self.pic.ref
        if y4 < 0 or x4 < 0 or x4 >= ref.shape[1] or ref[y4, x4] == -2:
            return False
        return ref[y4, x4] == -1 or not self.pps["constrained_intra"]

    def _sides(self, plane: int, y: int, x: int, n: int) -> tuple:
        """Left, corner and top samples of a square, None where they must not be read."""
        scale = 4 if plane == 0 else 2
        p = self.pic.planes[plane]
        left = p[y : y + n, x - 1] if self._readable(y // scale, (x - 1) // scale) else None
        top = p[y - 1, x : x + n] if self._readable((y - 1) // scale, x // scale) else None
        corner = int(p[y - 1, x - 1]) if self._readable((y - 1) // scale, (x - 1) // scale) else None
        return left, corner, top

    def _chroma(self, my: int, mx: int, mode: int) -> None:
        for i in (1, 2):
            self.pic.planes[i][8 * my : 8 * my + 8, 8 * mx : 8 * mx + 8] = prediction.intra_chroma(mode, *self._sides(i, 8 * my, 8 * mx, 8))

    def intra_blocks(self, my: int, mx: int) -> None:
        large = self.pps["transform_8x8"] and self.bits.flag()
        step = 2 if large else 1
        # Blocks in nested z-order: quarters of the macroblock, then quarters of these.
        places = [(4 * my + 2 * (q // 2) + s // 2, 4 * mx + 2 * (q % 2) + s % 2) for q in range(4) for s in range(1 if large else 4)]
        inside = lambda y, x: y // 4 == my and x // 4 == mx
        known = lambda y, x: int(self.pic.mode[y, x]) if inside(y, x) or self._readable(y, x) else None
        for y, x in places:
            mode = prediction.predicted_mode(known(y, x - 1), known(y - 1, x))
            if not self.bits.flag():
                rest = self.bits.u(3)
                mode = rest + (rest >= mode)
            self.pic.mode[y : y + step, x : x + step] = mode
        chroma = self.bits.ue()
        if self.bits.ue() != EMPTY_INTRA:
            raise Unsupported("residual coefficients")
        self._chroma(my, mx, chroma)
        n = 4 * step
        for y, x in places:
            left, corner, top = self._sides(0, 4 * y, 4 * x, n)
            if top is not None:
                more = self._readable(y - 1, x + step)
                top = np.concatenate([top, self.pic.planes[0][4 * y - 1, 4 * x + n : 4 * x + 2 * n] if more else np.repeat(top[-1], n)])
            if large:
                left, corner, top = prediction.filter_edges(left, corner, top)
            self.pic.planes[0][4 * y : 4 * y + n, 4 * x : 4 * x + n] = prediction.intra_square(int(self.pic.mode[y, x]), left, corner, top)
            self.pic.ref[y : y + step, x : x + step] = -1
        self.pic.large[my, mx] = large

    def intra_whole(self, my: int, mx: int, kind: int) -> None:
        chroma = self.bits.ue()
        self.qp = (self.qp + self.bits.se()) % 52
        self.pic.qp[my, mx] = self.qp
        if kind >= 4 or not self._empty_token(4 * my, 4 * mx):
            raise Unsupported("residual coefficients")
        self.pic.planes[0][16 * my : 16 * my + 16, 16 * mx : 16 * mx + 16] = prediction.intra_luma16(kind % 4, *self._sides(0, 16 * my, 16 * mx, 16))
        self._chroma(my, mx, chroma)
        self.pic.ref[4 * my : 4 * my + 4, 4 * mx : 4 * mx + 4] = -1

    def _empty_token(self, y: int, x: int) -> bool:
        """Whether the next coefficient token says none; its code depends on the neighbours' counts."""
        near = [int(self.pic.coefficients[v]) for v in ((y, x - 1), (y - 1, x)) if self.pic.neighbour(*v) is not None]
        expected = (sum(near) + 1) >> 1 if len(near) == 2 else sum(near)
        size, code = (1, 1) if expected < 2 else (2, 3) if expected < 4 else (4, 15) if expected < 8 else (6, 3)
        return self.bits.u(size) == code

    # Inter

    def _around(self, y: int, x: int, w: int) -> tuple:
        pic = self.pic
        return pic.neighbour(y, x - 1), pic.neighbour(y - 1, x), pic.neighbour(y - 1, x + w) or pic.neighbour(y - 1, x - 1)

    def _move(self, y: int, x: int, h: int, w: int, ref: int, mv: motion.Vector) -> None:
        """Set a partition's motion and predict its samples; places and sizes in 4x4 blocks."""
        if ref >= len(self.refs):
            raise Unsupported("missing reference picture")
        source = self.refs[ref]
        here = np.s_[y : y + h, x : x + w]
        self.pic.ref[here], self.pic.used[here], self.pic.mv[here] = ref, source.number, mv
        values = self.weights.get(ref)
        for i, plane in enumerate(source.planes):
            n, move = (4, prediction.inter_luma) if i == 0 else (2, prediction.inter_chroma)
            block = move(plane, n * y, n * x, n * h, n * w, mv)
            if values:
                weight, offset = values[2 * i : 2 * i + 2]
                shift = self.header["luma_log2_denom" if i == 0 else "chroma_log2_denom"]
                scaled = (block * weight + (1 << (shift - 1)) >> shift) if shift else block * weight
                block = np.clip(scaled + offset, 0, 255)
            self.pic.planes[i][n * y : n * y + n * h, n * x : n * x + n * w] = block

    def skipped(self, my: int, mx: int) -> None:
        y, x = 4 * my, 4 * mx
        self.pic.qp[my, mx] = self.qp
        self._move(y, x, 4, 4, 0, motion.predict_skip(*self._around(y, x, 4)))

    def _difference(self, mv: motion.Vector) -> motion.Vector:
        return mv[0] + self.bits.se(), mv[1] + self.bits.se()

    def inter_macroblock(self, my: int, mx: int, kind: int) -> None:
        y, x, most = 4 * my, 4 * mx, self.header["num_ref_l0"] - 1
        index = lambda: self.bits.te(most) if most > 0 else 0
        if kind < 3:
            h, w, shape = [(4, 4, "16x16"), (2, 4, "16x8"), (4, 2, "8x16")][kind]
            places = [(y + i, x + j) for i in range(0, 4, h) for j in range(0, 4, w)]
            refs = [index() for _ in places]
            for part, ((py, px), ref) in enumerate(zip(places, refs, strict=True)):
                around = self._around(py, px, w)
                guess = motion.predict(ref, *around) if kind == 0 else motion.predict_half(ref, shape, part, *around)
                self._move(py, px, h, w, ref, self._difference(guess))
        else:
            kinds = [self.bits.ue() for _ in range(4)]
            if max(kinds) > 3:
                raise Unsupported("sub macroblock type")
            refs = [index() if kind == 3 else 0 for _ in range(4)]
            for quarter, (sub, ref) in enumerate(zip(kinds, refs, strict=True)):
                h, w = SUB_PARTS[sub]
                for i in range(0, 2, h):
                    for j in range(0, 2, w):
                        py, px = y + 2 * (quarter // 2) + i, x + 2 * (quarter % 2) + j
                        self._move(py, px, h, w, ref, self._difference(motion.predict(ref, *self._around(py, px, w))))
        if self.bits.ue() != EMPTY_INTER:
            raise Unsupported("residual coefficients")


def reference_list(held: list[Picture], header: dict, span: int) -> list[Picture]:
    """List 0 of a P slice: the highest picture number first, then the slice's edits."""
    now = header["frame_num"]
    number = lambda p: p.header["frame_num"] - (span if p.header["frame_num"] > now else 0)
    found = sorted(held, key=lambda p: (-number(p), -p.number))
    wanted, at = now, 0
    for edit in header["list_edits"]:
        if edit["op"] > 1:
            raise Unsupported("long-term references")
        wanted = (wanted + (edit["value"] + 1) * (1 if edit["op"] else -1)) % span
        chosen = next((p for p in held if p.header["frame_num"] == wanted), None)
        if chosen is None:
            raise Unsupported("missing reference picture")
        found = found[:at] + [chosen] + [p for p in found[at:] if p is not chosen]
        at += 1
    return found[: header["num_ref_l0"]]


def decode_group(slices: Iterator[dict]) -> Iterator[tuple[dict, dict | None, Picture | None, int, str]]:
    """(slice row, SPS, picture, full picture order, status) of each slice; decoding stops at the first that cannot be decoded."""
    held: list[Picture] = []
    high = low = 0
    for number, row in enumerate(slices):
        sps, pps = row["sps"], row["pps"]
        picture, status, full = None, "ok", 0
        try:
            if not sps or not pps:
                raise Unsupported("no parameter set")
            if sps["parse_status"] != "ok" or pps["parse_status"] != "ok" or pps["cabac"]:
                raise Unsupported("CABAC" if pps["cabac"] else "parameter set")
            header, bits = parse_slice_header(row["payload"], row["nal_type"], row["ref_idc"], sps, pps)
            if header["parse_status"] != "ok" or header["slice_type"] not in (0, 2):
                raise Unsupported("slice type" if header["slice_type"] not in (0, 2) else f"slice header: {header['parse_status']}")
            if header["is_idr"]:
                held, high, low = [], 0, header["poc_lsb"]
            span = 1 << sps["log2_max_poc_lsb"] if sps["poc_type"] == 0 else 0
            jump = header["poc_lsb"] - low
            high += span * ((-jump >= span // 2) - (jump > span // 2)) if span else 0
            low = header["poc_lsb"]
            full = high + low if span else 2 * number
            frames = 1 << sps["log2_max_frame_num"]
            picture = Picture(number, sps, header)
            SliceDecoder(bits, header, sps, pps, picture, reference_list(held, header, frames) if header["slice_type"] == 0 else []).run()
            if header["deblock_idc"] != 1:
                intra = (picture.ref[::4, ::4] == -1) | (picture.ref[3::4, 3::4] == -1)
                edges = deblock.strengths(intra, np.zeros(picture.ref.shape, bool), picture.used[:, :, None], picture.mv[:, :, None, :])
                deblock.deblock_picture(picture.planes, picture.qp, *edges, alpha_offset=header["alpha_offset"], beta_offset=header["beta_offset"], chroma_offsets=(pps["chroma_qp_offset"], pps["second_chroma_qp_offset"]), transform_8x8=picture.large)
        except Unsupported as why:
            yield row, sps, None, full, f"unsupported: {why}"
            return
        yield row, sps, picture, full, "ok"
        if row["ref_idc"]:
            for op in header["memory_ops"]:
                if op["op"] == 1:
                    gone = (header["frame_num"] - op["a"] - 1) % frames
                    held = [p for p in held if p.header["frame_num"] != gone]
                elif op["op"] == 5:
                    held = []
            held = [*held, picture][-max(1, sps["num_ref_frames"]) :]


def decode_pictures(units: DataFrame) -> DataFrame:
    """NAL units -> one row for each plane (Y, U, V) of each picture, cropped, in 8-bit samples.

    ``decode_idx`` counts inside the group of pictures. A group that ends
    early has a last row with null samples and the reason as status. The only
    state that a task holds is one group's references.
    """
    order = Window.partitionBy("stream_id").orderBy("nal_idx").rowsBetween(Window.unboundedPreceding, 0)
    slices = resolve_slices(units).withColumn("gop", F.sum((F.col("nal_type") == 5).cast("long")).over(order))
    names = [c.split()[0] for c in PLANES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["nal_idx"])
        for at, (row, sps, picture, full, status) in enumerate(decode_group(iter(rows))):
            base = {"stream_id": row["stream_id"], "gop": row["gop"], "decode_idx": at, "nal_idx": row["nal_idx"], "is_idr": row["nal_type"] == 5, "status": status}
            if picture is None:
                yield pa.RecordBatch.from_pylist([base], schema=schema)
                continue
            out = []
            for name, plane in zip("YUV", picture.planes, strict=True):
                part = 1 if name == "Y" else 2
                top, left, h, w = (-(-sps[k] // part) for k in ("crop_top", "crop_left", "height", "width"))
                data = plane[top : top + h, left : left + w].astype(np.uint8).tobytes()
                out.append(base | {"frame_num": picture.header["frame_num"], "full_poc": full, "plane": name, "width": w, "height": h, "data": data})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return slices.groupBy("stream_id", "gop").applyInArrow(group, PLANES)
