"""Queries over bit streams that Spark writes from the tables: what the parsers give back is held against the columns that were coded."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lumaframe.operators import comparators
from lumaframe.plans.register import Register
from lumaframe.sources import annexb

registered = Register()


def u(n: int, v: Column | int) -> Column:
    return F.lpad(F.bin((v if isinstance(v, Column) else F.lit(v)).cast("long")), n, "0")


def ue(v: Column | int) -> Column:
    code = F.bin((v if isinstance(v, Column) else F.lit(v)).cast("long") + 1)
    return F.lpad(code, 2 * F.length(code) - 1, F.lit("0"))


def se(v: Column) -> Column:
    return ue(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def flag(v: Column) -> Column:
    return F.when(v, "1").otherwise("0")


def _hex(bits: Column) -> Column:
    """Bits with the stop bit and zeros up to a whole byte, as hex digits; emulation-prevention bytes put in."""
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  a value that is used more than once is computed once
    fill = lambda b: F.rpad(b, (F.ceil(F.length(b) / 8) * 8).cast("int"), F.lit("0"))
    pairs = lambda b: F.transform(F.sequence(F.lit(0), (F.length(b) / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(b, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    digits = bind(bind(F.concat(bits, F.lit("1")), fill), lambda b: F.array_join(pairs(b), " "))
    return F.regexp_replace(F.regexp_replace(digits, "00 00(?= 0[0-3])", "00 00 03"), " ", "")


def _unit(kind: Column | int, ref_idc: Column | int, bits: Column, long_code: bool = True) -> Column:
    """A unit behind its start code, as hex digits."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.concat(F.lit("00000001" if long_code else "000001"), F.lpad(F.hex((lit(ref_idc) * 32 + lit(kind)).cast("long")), 2, "0"), _hex(bits))


def _joined(*bits: Column) -> Column:
    return F.concat(*bits)


def _sps(number: Column | int, poc_type: Column, size: Column, wide: Column, high: Column, frames: Column, crop: Column, refs: Column, level: Column) -> Column:
    order = F.when(poc_type == 0, ue(size % 13)).when(poc_type == 1, _joined(flag(size % 2 == 0), se(size % 7 - 3), se(size % 5 - 2), ue(2), se(size % 9 - 4), se(size % 3))).otherwise("")
    cropping = F.when(crop > 0, _joined(F.lit("1"), ue(crop), ue(F.lit(0)), ue(F.lit(1)), ue(crop))).otherwise("0")
    return _joined(u(8, 77), u(8, 0), u(8, level), ue(number), ue(size % 13), ue(poc_type), order, ue(refs), F.lit("0"), ue(wide - 1), ue(high - 1), flag(frames), F.when(frames, "").otherwise("1"), F.lit("1"), cropping, F.lit("0"))


_PART = ["p_partkey", "p_size", "p_name"]


@registered.query("""
    SELECT p_partkey, p_partkey % 32 AS sps_id, p_size % 52 AS level, (4 + p_size % 13)::INTEGER AS log2_max_frame_num, (p_partkey % 3)::INTEGER AS poc_type, (CASE WHEN p_partkey % 3 = 0 THEN 4 + p_size % 13 ELSE 0 END)::INTEGER AS log2_max_poc_lsb,
           (p_size % 17)::INTEGER AS num_ref_frames, (p_partkey * 2 * 8 - CASE WHEN p_size % 4 > 0 THEN 2 * (p_size % 4) ELSE 0 END)::INTEGER AS width,
           greatest(0, 16 * (1 + p_size) * CASE WHEN p_partkey % 5 > 0 THEN 1 ELSE 2 END - CASE WHEN p_size % 4 > 0 THEN (1 + p_size % 4) * CASE WHEN p_partkey % 5 > 0 THEN 2 ELSE 4 END ELSE 0 END)::INTEGER AS height,
           CASE WHEN p_partkey % 5 > 0 THEN 'ok' ELSE 'unsupported' END AS parse_status
    FROM part WHERE p_partkey > 0""", part=_PART)  # fmt: skip
def sps_fields(part):
    key, size = F.col("p_partkey"), F.col("p_size")
    bits = _sps(key % 32, key % 3, size, key, 1 + size, key % 5 > 0, size % 4, size % 17, size % 52)
    streams = part.where(key > 0).select(key.cast("string").alias("stream_id"), F.unhex(_unit(7, 3, bits)).alias("content"))
    found = annexb.sps_table(annexb.nal_units(streams))
    return found.select(F.col("stream_id").cast("long").alias("p_partkey"), "sps_id", F.col("level_idc").alias("level"), "log2_max_frame_num", "poc_type", "log2_max_poc_lsb", "num_ref_frames", "width", "height", "parse_status")


_ORDER = ["o_orderkey", "o_custkey"]


@registered.query("""
    SELECT o_orderkey, n::BIGINT AS nal_idx, ((o_custkey + n) % 4)::INTEGER AS ref_idc, ((o_orderkey + n) % 13)::INTEGER AS nal_type, CASE WHEN (o_orderkey + n) % 13 BETWEEN 1 AND 5 THEN TRUE ELSE FALSE END AS is_slice,
           lower(format('{:08x}', o_custkey + 16843009)) || '80' AS payload
    FROM orders, (SELECT unnest(range(4)) AS n)""", orders=_ORDER)  # fmt: skip
def annexb_units(orders):
    units = [_unit((F.col("o_orderkey") + n) % 13, (F.col("o_custkey") + n) % 4, u(32, F.col("o_custkey") + 16843009), n % 2 == 0) for n in range(4)]
    # Bytes ahead of the first start code and zeros between units belong to no unit.
    streams = orders.select(F.col("o_orderkey").cast("string").alias("stream_id"), F.unhex(F.concat(F.lit("0102"), units[0], F.lit("0000"), *units[1:], F.lit("000000"))).alias("content"))
    found = annexb.nal_units(streams)
    return found.select(F.col("stream_id").cast("long").alias("o_orderkey"), "nal_idx", "ref_idc", "nal_type", annexb.is_slice(F.col("nal_type")).alias("is_slice"), F.lower(F.hex("payload")).alias("payload"))


_EVENT = ["user_id", "event_id", "event_type", "value"]


@registered.query("""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 AS kind, event_type <> 'error' AS is_ref, (1 + event_id % 3)::INTEGER AS refs,
                      last_value(CASE WHEN event_type = 'signup' THEN event_id % 11 - 5 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM events),
    f AS (SELECT *, n = 1 AS idr, [{'op': (event_id // 2) % 3, 'value': event_id % 40}, {'op': (event_id // 5) % 3, 'value': event_id % 7}][:event_id % 3] AS edits FROM e)
    SELECT user_id, n::BIGINT AS slice_no, kind::INTEGER AS slice_type, (event_id % 16)::BIGINT AS frame_num, (CASE WHEN idr THEN 5 ELSE 1 END = 5) AS is_idr, ((CAST(floor(abs(value)) AS BIGINT)) % 16)::BIGINT AS poc_lsb,
           (26 + coalesce(base, 0) + event_id % 9 - 4)::INTEGER AS qp, CASE WHEN kind < 2 THEN refs ELSE 1 END AS num_ref_l0, kind = 1 AND event_id % 2 = 0 AS direct_spatial,
           CASE WHEN kind < 2 THEN array_to_string(list_transform(edits, lambda x: x.op || ':' || x.value), ' ') ELSE '' END AS edits,
           CASE WHEN NOT is_ref AND NOT idr THEN '' WHEN idr THEN '0:0' WHEN event_id % 4 = 0 THEN '1:' || event_id % 6 ELSE CASE WHEN event_id % 4 = 1 THEN '3:2 5:0' ELSE '' END END AS ops,
           CASE WHEN kind = 0 THEN array_to_string(list_transform(range(refs), lambda r: CASE WHEN (event_id + r) % 2 = 0 THEN (event_id + r) % 30 - 15 ELSE 8 END), ' ') ELSE '' END AS luma_weights, 'ok' AS parse_status
    FROM f""", events=_EVENT)  # fmt: skip
def slice_fields(events):
    at, user = F.col("event_id"), "user_id"
    kind, is_ref, idr, refs = at % 3, F.col("event_type") != "error", F.col("n") == 1, 1 + at % 3
    rows = events.withColumn("n", F.row_number().over(Window.partitionBy(user).orderBy("event_id")))
    pps = lambda qp: _joined(ue(0), ue(0), F.lit("00"), ue(0), ue(0), ue(0), F.lit("1"), F.lit("00"), se(qp), se(F.lit(0)), se(F.lit(-2)), F.lit("100"))
    edit = lambda op, value: _joined(ue(op), ue(value))
    edits = F.when(at % 3 == 0, "0").otherwise(_joined(F.lit("1"), edit(F.floor(at / 2) % 3, at % 40), F.when(at % 3 == 2, edit(F.floor(at / 5) % 3, at % 7)).otherwise(""), ue(3)))
    weight = lambda r: F.when(r < refs, _joined(F.when((at + r) % 2 == 0, _joined(F.lit("1"), se((at + r) % 30 - 15), se(at % 5))).otherwise("0"), F.when(at % 5 == 0, _joined(F.lit("1"), *[se(F.lit(v)) for v in (3, 0, -4, 1)])).otherwise("0"))).otherwise("")
    weights = F.when(kind == 0, _joined(ue(3), ue(2), *[weight(F.lit(r)) for r in range(3)])).otherwise("")
    ops = F.when(at % 4 == 0, _joined(F.lit("1"), ue(1), ue(at % 6), ue(0))).when(at % 4 == 1, _joined(F.lit("1"), ue(3), ue(2), ue(1), ue(5), ue(0))).otherwise("0")
    override = F.when(kind == 0, _joined(F.lit("1"), ue(refs - 1))).when(kind == 1, _joined(F.lit("1"), ue(refs - 1), ue(0))).otherwise("")
    lists = F.when(kind == 0, edits).when(kind == 1, _joined(edits, F.lit("0"))).otherwise("")
    header = _joined(
        ue(0), ue(kind + 5), ue(0), u(4, at % 16), F.when(idr, ue(at % 3)).otherwise(""), u(4, F.floor(F.abs("value")) % 16), F.when(kind == 1, flag(at % 2 == 0)).otherwise(""), override, lists, weights,
        F.when(idr, "00").when(is_ref, ops).otherwise(""), se(at % 9 - 4), ue(1), F.lit("0110"),
    )
    slice_unit = _unit(F.when(idr, 5).otherwise(1), F.when(is_ref | idr, 2).otherwise(0), header)
    first = F.when(idr, F.concat(_unit(7, 3, _sps(0, F.lit(0), F.lit(0), F.lit(4), F.lit(3), F.lit(True), F.lit(0), F.lit(4), F.lit(30))), _unit(8, 3, pps(F.lit(0))))).otherwise("")
    again = F.when(F.col("event_type") == "signup", _unit(8, 3, pps(at % 11 - 5))).otherwise("")
    coded = rows.select(user, "event_id", F.concat(first, again, slice_unit).alias("units"))
    streams = coded.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("event_id", "units"))).alias("l"))
    streams = streams.select(F.col(user).cast("string").alias("stream_id"), F.unhex(F.array_join(F.transform("l", lambda x: x["units"]), "")).alias("content"))
    found = annexb.slice_headers(annexb.nal_units(streams))
    texts = lambda array, f: F.array_join(F.transform(array, f), " ")
    return found.select(
        F.col("stream_id").cast("long").alias("user_id"), F.row_number().over(Window.partitionBy("stream_id").orderBy("nal_idx")).cast("long").alias("slice_no"), "slice_type", "frame_num", "is_idr", "poc_lsb", "qp", "num_ref_l0", "direct_spatial",
        texts("list_edits", lambda e: F.concat_ws(":", e["op"], e["value"])).alias("edits"), texts("memory_ops", lambda o: F.concat_ws(":", o["op"], o["a"])).alias("ops"),
        texts("weights", lambda w: F.get(w["values"], F.lit(0)).cast("string")).alias("luma_weights"), "parse_status",
    )


@registered.query("""
    WITH e AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS digest FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL)
    SELECT e.doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN e.digest <> f.digest THEN 'differs' ELSE 'equal' END AS status FROM e LEFT JOIN f USING (doc_id)""", documents=["doc_id", "text"])  # fmt: skip
def hash_check(docs):
    docs = docs.where("text IS NOT NULL")
    expected = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")), 256).alias("digest"))
    return comparators.hash_check(docs.where("doc_id % 5 <> 0"), expected, "doc_id", "text", "digest").select("doc_id", "status")
