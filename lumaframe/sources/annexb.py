"""H.264 Annex B streams as tables: NAL units, parameter sets and slice headers.

``binaryFile`` gives one row for each stream; splitting and parsing are local
to a row and run on Arrow batches; files that are too large for a row are read
by ranges (see ranges.py). Which parameter set a slice uses is an as-of scan
over its stream (see ``resolve_slices``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.operators.scan import running_last

#: Names of NAL unit types.
NAL_TYPES = {1: "non-IDR slice", 2: "partition A", 3: "partition B", 4: "partition C", 5: "IDR slice", 6: "SEI", 7: "SPS", 8: "PPS", 9: "AUD", 10: "end of sequence", 11: "end of stream", 12: "filler"}
#: Profiles whose SPS carries chroma format, bit depths and scaling lists.
HIGH_PROFILES = {44, 83, 86, 100, 110, 118, 122, 128, 138, 139, 134, 135, 244}
_START = re.compile(b"\x00\x00\x01")
_ESCAPE = re.compile(b"\x00\x00\x03")


def split_units(stream: bytes) -> list[tuple[int, int, bytes]]:
    """(reference idc, type, payload) of each unit; none where there is no start code. Zeros that trail a unit are dropped."""
    starts = [m.end() for m in _START.finditer(stream)]
    out = []
    for at, after in zip(starts, [*(s - 3 for s in starts[1:]), len(stream)], strict=False):
        unit = stream[at:after].rstrip(b"\x00")
        if unit:
            out.append((unit[0] >> 5 & 3, unit[0] & 31, unit[1:]))
    return out


def unescape(payload: bytes) -> bytes:
    """The payload without emulation-prevention bytes."""
    return _ESCAPE.sub(b"\x00\x00", payload)


def escape(payload: bytes) -> bytes:
    """Emulation-prevention bytes put in."""
    return re.sub(b"\x00\x00(?=[\x00-\x03])", b"\x00\x00\x03", payload) + (b"\x03" if payload.endswith(b"\x00\x00") else b"")


class Bits:
    """A cursor over an unescaped payload. Bits past the end are zeros."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data), 8 * len(data), 0

    def u(self, n: int) -> int:
        self.at += n
        shift = self.size - self.at
        return (self.value >> shift if shift >= 0 else self.value << -shift) & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.u(1) == 1

    def ue(self) -> int:
        zeros = 0
        while not self.u(1):
            zeros += 1
            if zeros > 31:
                return 0
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v & 1 else -(v // 2)

    def te(self, most: int) -> int:
        return 1 - self.u(1) if most == 1 else min(self.ue(), most)

    def align(self) -> None:
        self.at += -self.at % 8

    def peek(self, n: int) -> int:
        at, v = self.at, self.u(n)
        self.at = at
        return v

    def left(self) -> int:
        return self.size - self.at

    def more_data(self) -> bool:
        """Whether anything but the stop bit and zeros is left."""
        left = self.left()
        rest = self.value & ((1 << left) - 1) if left > 0 else 0
        return rest != 0 and rest & (rest - 1) != 0 or rest != 0 and rest.bit_length() != left


def _skip_scaling_list(bits: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + bits.se()) % 256
        last = following or last


def parse_sps(payload: bytes) -> dict:
    bits = Bits(unescape(payload))
    s = {"profile_idc": bits.u(8), "constraints": bits.u(8), "level_idc": bits.u(8), "sps_id": bits.ue(), "chroma_format_idc": 1, "bit_depth_luma": 8, "bit_depth_chroma": 8, "scaling_matrix": False}
    if s["profile_idc"] in HIGH_PROFILES:
        s["chroma_format_idc"] = bits.ue()
        if s["chroma_format_idc"] == 3:
            bits.u(1)
        s["bit_depth_luma"], s["bit_depth_chroma"] = 8 + bits.ue(), 8 + bits.ue()
        bits.u(1)
        s["scaling_matrix"] = bits.flag()
        if s["scaling_matrix"]:
            for i in range(8 if s["chroma_format_idc"] != 3 else 12):
                if bits.flag():
                    _skip_scaling_list(bits, 16 if i < 6 else 64)
    s["log2_max_frame_num"], s["poc_type"], s["log2_max_poc_lsb"] = 4 + bits.ue(), bits.ue(), 0
    s["delta_pic_order_always_zero"] = False
    if s["poc_type"] == 0:
        s["log2_max_poc_lsb"] = 4 + bits.ue()
    elif s["poc_type"] == 1:
        s["delta_pic_order_always_zero"] = bits.flag()
        bits.se(), bits.se()
        for _ in range(min(bits.ue(), 255)):
            bits.se()
    s["num_ref_frames"] = bits.ue()
    bits.u(1)
    s["mbs_wide"], units = 1 + bits.ue(), 1 + bits.ue()
    s["frame_mbs_only"] = bits.flag()
    s["mbs_high"] = units * (1 if s["frame_mbs_only"] else 2)
    if not s["frame_mbs_only"]:
        bits.u(1)
    s["direct_8x8_inference"] = bits.flag()
    crop = [bits.ue() for _ in range(4)] if bits.flag() else [0] * 4
    x = 2 if s["chroma_format_idc"] in (1, 2) else 1
    y = (2 if s["chroma_format_idc"] == 1 else 1) * (1 if s["frame_mbs_only"] else 2)
    s["crop_left"], s["crop_top"] = crop[0] * x, crop[2] * y
    s["width"] = max(0, 16 * s["mbs_wide"] - (crop[0] + crop[1]) * x)
    s["height"] = max(0, 16 * s["mbs_high"] - (crop[2] + crop[3]) * y)
    unsupported = s["chroma_format_idc"] != 1 or s["bit_depth_luma"] != 8 or s["bit_depth_chroma"] != 8 or not s["frame_mbs_only"]
    s["parse_status"] = "truncated" if bits.left() < 0 else "unsupported" if unsupported else "ok"
    return s


def parse_pps(payload: bytes) -> dict:
    bits = Bits(unescape(payload))
    p = {"pps_id": bits.ue(), "sps_id": bits.ue(), "cabac": bits.flag(), "bottom_field_pic_order": bits.flag()}
    p["slice_groups"] = 1 + bits.ue()
    if p["slice_groups"] > 1:
        kind, n = bits.ue(), p["slice_groups"]
        if kind == 0:
            [bits.ue() for _ in range(min(n, 8))]
        elif kind == 2:
            [bits.ue() for _ in range(2 * (min(n, 8) - 1))]
        elif kind in (3, 4, 5):
            bits.u(1), bits.ue()
        elif kind == 6:
            count = 1 + bits.ue()
            [bits.u((n - 1).bit_length()) for _ in range(min(count, bits.left()))]
    p["num_ref_l0"], p["num_ref_l1"] = 1 + bits.ue(), 1 + bits.ue()
    p["weighted_pred"], p["weighted_bipred"] = bits.flag(), bits.u(2)
    p["init_qp"], _ = 26 + bits.se(), bits.se()
    p["chroma_qp_offset"] = bits.se()
    p["deblocking_control"], p["constrained_intra"], p["redundant_pic_cnt"] = bits.flag(), bits.flag(), bits.flag()
    p["transform_8x8"], p["second_chroma_qp_offset"] = False, p["chroma_qp_offset"]
    if bits.more_data():
        p["transform_8x8"] = bits.flag()
        if bits.flag():
            for i in range(6 + 2 * p["transform_8x8"]):
                if bits.flag():
                    _skip_scaling_list(bits, 16 if i < 6 else 64)
        p["second_chroma_qp_offset"] = bits.se()
    p["parse_status"] = "truncated" if bits.left() < 0 else "unsupported" if p["slice_groups"] > 1 else "ok"
    return p


def slice_pps_id(payload: bytes) -> int:
    bits = Bits(unescape(payload[:16]))
    bits.ue(), bits.ue()
    return bits.ue()


def parse_slice_header(payload: bytes, nal_type: int, ref_idc: int, sps: dict, pps: dict) -> tuple[dict, Bits]:
    """The header's fields and the cursor at the slice data."""
    bits = Bits(unescape(payload))
    h: dict = {"first_mb": bits.ue(), "slice_type": bits.ue() % 5, "pps_id": bits.ue(), "frame_num": bits.u(sps["log2_max_frame_num"]), "is_idr": nal_type == 5}
    field = not sps["frame_mbs_only"] and bits.flag()
    if field:
        bits.u(1)
    h["idr_pic_id"] = bits.ue() if h["is_idr"] else None
    h["poc_lsb"] = 0
    if sps["poc_type"] == 0:
        h["poc_lsb"] = bits.u(sps["log2_max_poc_lsb"])
        if pps["bottom_field_pic_order"] and not field:
            bits.se()
    elif sps["poc_type"] == 1 and not sps["delta_pic_order_always_zero"]:
        bits.se()
        if pps["bottom_field_pic_order"] and not field:
            bits.se()
    if pps["redundant_pic_cnt"]:
        bits.ue()
    p, b = h["slice_type"] in (0, 3), h["slice_type"] == 1
    h["direct_spatial"] = bits.flag() if b else False
    h["num_ref_l0"], h["num_ref_l1"] = pps["num_ref_l0"], pps["num_ref_l1"]
    if (p or b) and bits.flag():
        h["num_ref_l0"] = 1 + bits.ue()
        if b:
            h["num_ref_l1"] = 1 + bits.ue()
    h["list_edits"] = []
    for number in range((p or b) + b):
        if bits.flag():
            while (op := bits.ue()) != 3 and bits.left() > 0:
                h["list_edits"].append({"list": number, "op": op, "value": bits.ue()})
    h["weights"] = []
    h["luma_log2_denom"], h["chroma_log2_denom"] = 0, 0
    if pps["weighted_pred"] and p or pps["weighted_bipred"] == 1 and b:
        h["luma_log2_denom"], h["chroma_log2_denom"] = bits.ue(), bits.ue()
        for number, n in ((0, h["num_ref_l0"]), (1, h["num_ref_l1"]))[: 1 + b]:
            for ref in range(min(n, 32)):
                w = [1 << h["luma_log2_denom"], 0, 1 << h["chroma_log2_denom"], 0, 1 << h["chroma_log2_denom"], 0]
                if bits.flag():
                    w[0:2] = bits.se(), bits.se()
                if bits.flag():
                    w[2:6] = bits.se(), bits.se(), bits.se(), bits.se()
                h["weights"].append({"list": number, "ref": ref, "values": w})
    h["memory_ops"] = []
    if ref_idc:
        if h["is_idr"]:
            h["memory_ops"].append({"op": 0, "a": bits.u(1), "b": bits.u(1)})
        elif bits.flag():
            while (op := bits.ue()) and bits.left() > 0:
                a = bits.ue() if op in (1, 2, 3, 4, 6) else 0
                h["memory_ops"].append({"op": op, "a": a, "b": bits.ue() if op == 3 else 0})
    h["cabac_init_idc"] = bits.ue() if pps["cabac"] and (p or b) else 0
    h["qp"] = pps["init_qp"] + bits.se()
    if h["slice_type"] in (3, 4):
        if h["slice_type"] == 3:
            bits.u(1)
        bits.se()
    h["deblock_idc"], h["alpha_offset"], h["beta_offset"] = 0, 0, 0
    if pps["deblocking_control"]:
        h["deblock_idc"] = bits.ue()
        if h["deblock_idc"] != 1:
            h["alpha_offset"], h["beta_offset"] = 2 * bits.se(), 2 * bits.se()
    h["parse_status"] = "truncated" if bits.left() < 0 else "unsupported" if h["slice_type"] in (3, 4) or h["first_mb"] or field else "ok"
    return h, bits


SPS_SCHEMA = "profile_idc int, constraints int, level_idc int, sps_id bigint, chroma_format_idc int, bit_depth_luma int, bit_depth_chroma int, scaling_matrix boolean, log2_max_frame_num int, poc_type int, log2_max_poc_lsb int, delta_pic_order_always_zero boolean, num_ref_frames int, mbs_wide int, mbs_high int, frame_mbs_only boolean, direct_8x8_inference boolean, crop_left int, crop_top int, width int, height int, parse_status string"
PPS_SCHEMA = "pps_id bigint, sps_id bigint, cabac boolean, bottom_field_pic_order boolean, slice_groups int, num_ref_l0 int, num_ref_l1 int, weighted_pred boolean, weighted_bipred int, init_qp int, chroma_qp_offset int, deblocking_control boolean, constrained_intra boolean, redundant_pic_cnt boolean, transform_8x8 boolean, second_chroma_qp_offset int, parse_status string"
SLICE_SCHEMA = "first_mb bigint, slice_type int, pps_id bigint, frame_num bigint, is_idr boolean, idr_pic_id bigint, poc_lsb bigint, direct_spatial boolean, num_ref_l0 int, num_ref_l1 int, list_edits array<struct<list:int,op:int,value:bigint>>, weights array<struct<list:int,ref:int,values:array<int>>>, luma_log2_denom int, chroma_log2_denom int, memory_ops array<struct<op:int,a:bigint,b:bigint>>, cabac_init_idc int, qp int, deblock_idc int, alpha_offset int, beta_offset int, parse_status string"


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """stream_id and content of each file; a null content is a missing stream and has no units."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), "content")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of whole streams; batches are filled across streams, so that many short ones do not make as many batches."""
    held: list[tuple] = []

    def full(least_rows: int, least_bytes: int) -> Iterator[pa.RecordBatch]:
        if held and (len(held) >= least_rows or sum(len(r[4]) for r in held[-1024:]) >= least_bytes):
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
            held.clear()
            yield pa.RecordBatch.from_arrays(columns, names=["stream_id", "nal_idx", "ref_idc", "nal_type", "payload"])

    for batch in batches:
        for stream, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for n, unit in enumerate(split_units(content.as_py() or b"")):
                held.append((stream, n, *unit))
                if len(held) % 64 == 0 or len(unit[2]) > 1 << 20:
                    yield from full(1024, 8 << 20)
    yield from full(1, 0)


def nal_units(streams: DataFrame) -> DataFrame:
    """(stream_id, nal_idx, ref_idc, nal_type, payload) of every unit."""
    return streams.select(F.col("stream_id").cast("string"), "content").mapInArrow(_units, "stream_id string, nal_idx long, ref_idc int, nal_type int, payload binary")


def type_name(nal_type):
    table = F.create_map(*[F.lit(x) for pair in NAL_TYPES.items() for x in pair])
    return F.coalesce(table[nal_type], F.lit("other"))


def is_slice(nal_type):
    return nal_type.between(1, 5)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _parsed(units: DataFrame, kind: int, schema: str, parse) -> DataFrame:
    schema = f"stream_id string, nal_idx long, {schema}"
    typed = _arrow(schema)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"stream_id": r["stream_id"], "nal_idx": r["nal_idx"], **parse(r["payload"])} for r in batch.to_pylist()], schema=typed)

    return units.where(F.col("nal_type") == kind).select("stream_id", "nal_idx", "payload").mapInArrow(rows, schema)


def sps_table(units: DataFrame) -> DataFrame:
    return _parsed(units, 7, SPS_SCHEMA, parse_sps)


def pps_table(units: DataFrame) -> DataFrame:
    return _parsed(units, 8, PPS_SCHEMA, parse_pps)


def resolve_slices(units: DataFrame) -> DataFrame:
    """Slice units with the PPS in force for the id they name and the SPS in force, at the slice, for the id which that names.

    Two as-of steps, each a scan over ranges of the stream. Only numbers and
    ids run through them; payloads are joined afterwards. Slices without a set
    have null for it.
    """
    fields = lambda schema: F.struct(*[c.split()[0] for c in schema.split(", ")])
    sps = sps_table(units).select("stream_id", "nal_idx", fields(SPS_SCHEMA).alias("sps"))
    pps = pps_table(units).select("stream_id", "nal_idx", fields(PPS_SCHEMA).alias("pps"))

    def ids(batches):
        for batch in batches:
            found = pa.array([slice_pps_id(p) for p in batch.column("head").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("stream_id"), batch.column("nal_idx"), found], names=["stream_id", "nal_idx", "pps_id"])

    slices = units.where(F.col("nal_type").isin(1, 5))
    named = slices.select("stream_id", "nal_idx", F.substring("payload", 1, 16).alias("head")).mapInArrow(ids, "stream_id string, nal_idx long, pps_id long")

    def in_force(uses: DataFrame, sets: DataFrame, name: str, key: str) -> DataFrame:
        both = uses.withColumn("_use", F.lit(True)).unionByName(sets.withColumn(key, F.col(f"{name}.{key}")), allowMissingColumns=True)
        return running_last(both, ["stream_id", key], "nal_idx", F.col(name), name).where("_use").drop("_use", key)

    with_pps = in_force(named, pps, "pps", "pps_id").withColumn("sps_id", F.col("pps.sps_id"))
    both = in_force(with_pps, sps, "sps", "sps_id")
    return slices.select("stream_id", "nal_idx", "ref_idc", "nal_type", "payload").join(both.hint("merge"), ["stream_id", "nal_idx"])


def slice_headers(units: DataFrame) -> DataFrame:
    """(stream_id, nal_idx, ref_idc, width, height and the header's fields); parse_status says ``no parameter set`` where one is missing."""

    schema = f"stream_id string, nal_idx long, ref_idc int, width int, height int, {SLICE_SCHEMA}"
    typed = _arrow(schema)

    def header(r: dict) -> dict:
        if not r["sps"] or not r["pps"]:
            return {"parse_status": "no parameter set"}
        fields, _ = parse_slice_header(r["payload"], r["nal_type"], r["ref_idc"], r["sps"], r["pps"])
        return {"width": r["sps"]["width"], "height": r["sps"]["height"], **fields}

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("stream_id", "nal_idx", "ref_idc")} | header(r) for r in batch.to_pylist()], schema=typed)

    return resolve_slices(units).mapInArrow(rows, schema)
