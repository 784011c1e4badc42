"""All queries of the library by name, with the SQL that DuckDB runs on the same tables.

The tables hold no video. Each query applies one of the library's operators to
columns of the same shape, so its result can be held against another engine;
that checks the operator's arithmetic and ordering, not any decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import blocks, deblock, scalar
from lumaframe.operators import comparators, compare, sequence
from lumaframe.plans import bitstreams, comparisons, macroblocks, pictures
from lumaframe.plans.register import Query, component
from lumaframe.sources import traces

_MODULES = [comparisons, macroblocks, pictures, bitstreams]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(table: str, columns: list[str], sql: str):
    """Register a function of one table's columns; pruning happens before anything else."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns))
        _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return {k: v for found in (_QUERIES, *(m.registered.queries for m in _MODULES)) for k, v in found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for found in (_SQL, *(m.registered.sql for m in _MODULES)) for k, v in found.items()}


EVENT = ["user_id", "event_id"]
_LSB = "CAST(floor(abs(value)) AS BIGINT) % 16"
_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@_query("events", [*EVENT, "event_type", "value"], f"""
    WITH g AS (SELECT *, CAST(sum(CASE WHEN rn = 1 OR event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS BIGINT) AS gop
               FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))
    SELECT user_id, event_id, gop, row_number() OVER (PARTITION BY user_id, gop ORDER BY floor(value), event_id)::BIGINT AS display_rank FROM g""")
def display_order(events):
    grouped = sequence.assign_gop(events, "user_id", "event_id", F.col("event_type") == "signup")
    return sequence.display_order(grouped, "user_id", "event_id", F.floor("value")).select(*EVENT, "gop", "display_rank")


@_query("events", [*EVENT, "value"], f"""
    WITH l AS (SELECT user_id, event_id, {_LSB} AS lsb FROM events),
    p AS (SELECT *, lag(lsb) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM l)
    SELECT user_id, event_id, CAST(lsb + 16 * sum(CASE WHEN prev - lsb >= 8 THEN 1 WHEN lsb - prev > 8 THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS BIGINT) AS full_poc FROM p""")
def poc_unwrap(events):
    return sequence.unwrap_poc(events, "user_id", "event_id", F.floor(F.abs("value")) % 16, 16).select(*EVENT, "full_poc")


@_query("events", [*EVENT, "value"], f"""
    SELECT user_id, event_id, CAST(((26 + sum(d) OVER (PARTITION BY user_id ORDER BY event_id {_RUN})) % 52 + 52) % 52 AS BIGINT) AS qp
    FROM (SELECT *, CAST(floor(abs(value)) AS BIGINT) % 27 - 13 AS d FROM events)""")
def qp_track(events):
    return sequence.track_qp(events, "user_id", "event_id", 26, F.floor(F.abs("value")) % 27 - 13).select(*EVENT, "qp")


@_query("events", [*EVENT, "event_type"], f"""
    SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS active FROM events""")
def param_asof(events):
    return sequence.resolve_parameters(events, "user_id", "event_id", F.col("event_type") == "signup", F.col("event_id"), "active").select(*EVENT, "active")


@_query("events", [*EVENT, "event_type"], """
    WITH k AS (SELECT user_id, event_id, event_type, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events)
    SELECT c.user_id, c.event_id, count(r.event_id)::BIGINT AS n_refs, min(r.event_id) AS oldest, max(r.event_id) AS newest
    FROM k c LEFT JOIN k r ON r.user_id = c.user_id AND r.event_type <> 'error' AND r.k >= c.k - 4 AND r.k < c.k GROUP BY 1, 2""")
def dpb_refs(events):
    held = sequence.reference_window(events, "user_id", "event_id", F.col("event_type") != "error", 4)
    return held.select(*EVENT, F.size("refs").cast("long").alias("n_refs"), F.array_min("refs").alias("oldest"), F.array_max("refs").alias("newest"))


@_query("events", [*EVENT, "event_type", "value"], """
    WITH k AS (SELECT *, CAST(floor(abs(value) / 20) AS BIGINT) AS n, CAST(floor(value) AS BIGINT) AS p, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events),
    j AS (SELECT c.user_id, c.event_id, c.p AS now, r.event_id AS ref, r.n, r.p FROM k c JOIN k r ON r.user_id = c.user_id AND r.event_type <> 'error' AND r.k >= c.k - 4 AND r.k < c.k),
    z AS (SELECT user_id, event_id, 0 AS list, row_number() OVER (PARTITION BY user_id, event_id ORDER BY p DESC, ref) AS place, ref FROM j WHERE p < now),
    o AS (SELECT user_id, event_id, 1 AS list, row_number() OVER (PARTITION BY user_id, event_id ORDER BY CASE WHEN p > now THEN 0 ELSE 1 END, CASE WHEN p > now THEN p ELSE -p END, n DESC, ref) AS place, ref FROM j)
    SELECT user_id, event_id, list, place::INT AS place, ref FROM (SELECT * FROM z UNION ALL SELECT * FROM o)""")
def ref_list_b(events):
    pictures = events.select(*EVENT, F.floor(F.abs(F.col("value")) / 20).alias("n"), F.floor("value").alias("p"), "event_type")
    return sequence.reference_lists_b(pictures, "user_id", "event_id", "n", "p", F.col("event_type") != "error", 4)


@_query("events", [*EVENT, "value"], f"""
    SELECT user_id, event_id, CAST(sum(CASE WHEN item <= prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS BIGINT) AS occurrence
    FROM (SELECT *, lag(item) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM (SELECT *, CAST(floor(value) AS BIGINT) AS item FROM events))""")
def occurrence(events):
    return sequence.occurrence(events.withColumn("item", F.floor("value")), ["user_id"], "event_id", "item").select(*EVENT, "occurrence")


@_query("events", [*EVENT, "event_type"], "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS repeat FROM events")
def repeat_number(events):
    return sequence.repeat_number(events, ["user_id", "event_type"], "event_id")


@_query("documents", ["doc_id", "text"], "SELECT doc_id, n::BIGINT AS unit_no, md5(u) AS unit_md5 FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS u, unnest(range(len(string_split(text, ' ')))) AS n FROM documents)")
def unit_split(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "u")).select("doc_id", F.col("n").cast("long").alias("unit_no"), F.md5("u").alias("unit_md5"))


@_query("documents", ["doc_id", "text"], "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha_check(docs):
    return docs.select("doc_id", F.sha2("text", 256).alias("digest"))


ITEM = ["l_orderkey", "l_linenumber"]
_Q = "CAST(floor(l_quantity) AS BIGINT)"
_P = "CAST(floor(l_extendedprice) AS BIGINT) % 256"


def _quantity():
    return F.floor("l_quantity")


def _price():
    return F.floor("l_extendedprice") % 256


@_query("lineitem", [*ITEM, "l_partkey"], "SELECT l_orderkey, l_linenumber, CAST(2 * length(bin(l_partkey + 1)) - 1 AS BIGINT) AS bits FROM lineitem")
def ue_len(items):
    return items.select(*ITEM, scalar.ue_length(F.col("l_partkey")).alias("bits"))


@_query("lineitem", [*ITEM, "l_partkey"], "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN -(l_partkey // 2) ELSE (l_partkey + 1) // 2 END AS v FROM lineitem")
def se_map(items):
    return items.select(*ITEM, scalar.se_value(F.col("l_partkey")).alias("v"))


@_query("lineitem", [*ITEM, "l_quantity"], f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 1 - least({_Q} - 1, 1) ELSE least({_Q} - 1, 10) END AS v FROM lineitem")
def te_map(items):
    return items.select(*ITEM, scalar.te_value(_quantity() - 1, F.when(F.col("l_linenumber") % 2 == 1, F.lit(1)).otherwise(F.lit(10))).cast("long").alias("v"))


@_query("lineitem", [*ITEM, "l_quantity", "l_discount"], f"SELECT l_orderkey, l_linenumber, [0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22,23,24,25,26,27,28,29,29,30,31,32,32,33,34,34,35,35,36,36,37,37,37,38,38,38,39,39,39,39][greatest(0, least(51, {_Q} + CAST(round(l_discount * 100) AS BIGINT) - 5)) + 1]::INT AS qpc FROM lineitem")
def chroma_qp(items):
    return items.select(*ITEM, scalar.chroma_qp(_quantity(), F.round(F.col("l_discount") * 100).cast("int") - 5).alias("qpc"))


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice", "l_partkey"], f"SELECT l_orderkey, l_linenumber, list_sort([{_Q}, {_P}, l_partkey % 100])[2] AS median FROM lineitem")
def median3(items):
    return items.select(*ITEM, scalar.median3(_quantity(), _price(), F.col("l_partkey") % 100).alias("median"))


@_query("lineitem", [*ITEM, "l_partkey"], "SELECT l_orderkey, l_linenumber, CAST((((l_partkey * 7919 + 32768) % 65536 + 65536) % 65536) - 32768 AS BIGINT) AS wrapped FROM lineitem")
def int16_wrap(items):
    return items.select(*ITEM, scalar.wrap16(F.col("l_partkey") * 7919).alias("wrapped"))


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice", "l_partkey"], f"""
    WITH s AS (SELECT *, {_P} AS y, {_Q} * 5 - cr0 AS cb, l_partkey % 256 - 128 AS cr FROM (SELECT *, 128 AS cr0 FROM lineitem))
    SELECT l_orderkey, l_linenumber, greatest(0, least(255, y + ((cr * 1436) >> 10))) AS r, greatest(0, least(255, y - ((cb * 352 + cr * 731) >> 10))) AS g, greatest(0, least(255, y + ((cb * 1814) >> 10))) AS b FROM s""")
def yuv_rgb(items):
    return items.select(*ITEM, scalar.yuv_to_rgb(_price(), _quantity() * 5, F.col("l_partkey") % 256).alias("p")).select(*ITEM, "p.r", "p.g", "p.b")


@_query("lineitem", [*ITEM, "l_quantity", "l_partkey"], f"""
    WITH d AS (SELECT *, greatest(-128, least(127, 50 - {_Q})) AS tb, greatest(-128, least(127, l_partkey % 100 - {_Q})) AS td FROM lineitem),
    s AS (SELECT *, greatest(-1024, least(1023, (tb * ((16384 + abs(td // 2)) // nullif(td, 0)) + 32) >> 6)) >> 2 AS w FROM d)
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN w BETWEEN -64 AND 128 THEN w ELSE 32 END AS BIGINT) AS w1 FROM s""")
def implicit_weights(items):
    return items.select(*ITEM, scalar.implicit_weight(F.lit(50), _quantity(), F.col("l_partkey") % 100).alias("w1"))


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice", "l_partkey"], f"""
    WITH s AS (SELECT *, {_P} AS a, l_partkey % 256 AS b, {_Q} AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN w = 32 THEN (a + b + 1) >> 1 ELSE greatest(0, least(255, (a * (64 - w) + b * w + 32) >> 6)) END AS blend, greatest(0, least(255, ((a * w + 16) >> 5) + 3)) AS weighted FROM s""")
def weighted_prediction(items):
    a, b, w = _price(), F.col("l_partkey") % 256, _quantity()
    return items.select(*ITEM, scalar.bi_blend(a, b, w).alias("blend"), scalar.weighted_sample(a, w, F.lit(3), 5).alias("weighted"))


@_query("lineitem", [*ITEM, "l_quantity", "l_partkey", "l_returnflag", "l_tax"], f"""
    SELECT a.l_orderkey, a.l_linenumber, CAST(CASE WHEN a.l_returnflag = 'R' AND a.l_linenumber % 2 = 0 THEN 4 WHEN a.l_returnflag = 'R' THEN 3 WHEN a.l_tax > 0.06 THEN 2
        WHEN abs({_Q.replace('l_quantity', 'a.l_quantity')} - {_Q.replace('l_quantity', 'b.l_quantity')}) >= 4 OR abs(a.l_partkey % 16 - b.l_partkey % 16) >= 4 THEN 1 ELSE 0 END AS BIGINT) AS bs
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1""")
def bs_strength(items):
    here = items.select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax", _quantity().alias("ax"), (F.col("l_partkey") % 16).alias("ay"))
    left = items.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), _quantity().alias("bx"), (F.col("l_partkey") % 16).alias("by"))
    moved = scalar.moves_apart(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return here.join(left, ITEM).select(*ITEM, scalar.boundary_strength(F.col("l_returnflag") == "R", F.col("l_linenumber") % 2 == 0, F.col("l_tax") > 0.06, moved).alias("bs"))


def _block(vectors: DataFrame, at: int = 0) -> DataFrame:
    """Sixteen components in -127..127 as a block."""
    return vectors.select("vec_id", "label", F.transform(F.slice("embedding", at + 1, 16), component).alias("x"))


_V16 = "list_transform(embedding[1:16], lambda v: CAST(floor(v * 127::FLOAT) AS BIGINT))"
_B = f"WITH b AS (SELECT vec_id, label, {_V16} AS x FROM embeddings)"


def _spread(name: str) -> list:
    return [F.get(name, F.lit(i)).cast("long").alias(f"c{i}") for i in range(16)]


@_query("embeddings", ["vec_id", "label", "embedding"], f"{_B} SELECT vec_id, " + ", ".join(f"x[{at + 1}] AS c{p}" for p, at in enumerate([0, 1, 5, 6, 2, 4, 7, 12, 3, 8, 11, 13, 9, 10, 14, 15])) + " FROM b")
def zigzag(vectors):
    return _block(vectors).select("vec_id", blocks.inverse_scan(F.col("x")).alias("y")).select("vec_id", *_spread("y"))


@_query("embeddings", ["vec_id", "label", "embedding"], f"{_B} SELECT vec_id, " + ", ".join(f"x[{p + 1}] * {[[10, 11, 13, 14, 16, 18], [13, 14, 16, 18, 20, 23], [16, 18, 20, 23, 25, 29]][p // 4 % 2 + p % 2]}[(vec_id % 52) % 6 + 1] * (1::BIGINT << ((vec_id % 52) // 6)) AS c{p}" for p in range(16)) + " FROM b")
def dequant(vectors):
    return _block(vectors).select("vec_id", blocks.dequant4x4(F.col("x"), F.col("vec_id") % 52).alias("y")).select("vec_id", *_spread("y"))


def _signed(terms: list[tuple[int, str]]) -> str:
    return "(" + " ".join(("+ " if s > 0 else "- ") + t for s, t in terms) + ")"


def _hadamard_sql(x: str = "x") -> str:
    h = [[1, 1, 1, 1], [1, 1, -1, -1], [1, -1, -1, 1], [1, -1, 1, -1]]
    return ", ".join(_signed([(h[r][k] * h[c][m], f"{x}[{4 * k + m + 1}]") for k in range(4) for m in range(4)]) + f" AS c{4 * r + c}" for r in range(4) for c in range(4))


@_query("embeddings", ["vec_id", "label", "embedding"], f"{_B} SELECT vec_id, {_hadamard_sql()} FROM b")
def hadamard(vectors):
    return _block(vectors).select("vec_id", blocks.hadamard4x4(F.col("x")).alias("y")).select("vec_id", *_spread("y"))


def _idct_sql() -> str:
    def lines(name, at):
        out = {}
        for n in range(4):
            a, b, c, d = (name(at(n, k)) for k in range(4))
            out |= {at(n, 0): f"{a} + {c} + {b} + ({d} >> 1)", at(n, 1): f"{a} - {c} + ({b} >> 1) - {d}", at(n, 2): f"{a} - {c} - ({b} >> 1) + {d}", at(n, 3): f"{a} + {c} - {b} - ({d} >> 1)"}
        return out

    once = lines(lambda p: f"x[{p + 1}]", lambda n, k: 4 * n + k)
    twice = lines(lambda p: f"t{p}", lambda n, k: 4 * k + n)
    return f"{_B}, o AS (SELECT vec_id, {', '.join(f'{v} AS t{p}' for p, v in once.items())} FROM b) SELECT vec_id, {', '.join(f'(({v}) + 32) >> 6 AS c{p}' for p, v in twice.items())} FROM o"


@_query("embeddings", ["vec_id", "label", "embedding"], _idct_sql())
def idct4x4(vectors):
    return _block(vectors).select("vec_id", blocks.idct4x4_column(F.col("x")).alias("y")).select("vec_id", *_spread("y"))


_V = "list_transform(embedding, lambda v: CAST(floor(v * 127::FLOAT) AS BIGINT))"


@_query("embeddings", ["vec_id", "label", "embedding"], f"""
    WITH q AS (SELECT vec_id, label, {_V} AS x FROM embeddings)
    SELECT a.vec_id, b.vec_id AS other_id, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))) AS BIGINT) AS sad FROM q a JOIN q b ON b.vec_id = a.vec_id + 1""")
def sad(vectors):
    x = vectors.select("vec_id", F.transform("embedding", lambda v: F.floor(v * 127)).alias("x"))
    after = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("x").alias("y"))
    return x.join(after, "vec_id").select("vec_id", "other_id", blocks.sad(F.col("x"), F.col("y")).alias("sad"))


@_query("embeddings", ["vec_id", "label", "embedding"], f"""
    WITH b AS (SELECT vec_id, list_transform(list_zip(embedding[1:16], embedding[17:32]), lambda p: CAST(floor(p[1] * 127::FLOAT) AS BIGINT) - CAST(floor(p[2] * 127::FLOAT) AS BIGINT)) AS x FROM embeddings),
    h AS (SELECT vec_id, {_hadamard_sql()} FROM b) SELECT vec_id, ({' + '.join(f'abs(c{i})' for i in range(16))} + 1) >> 1 AS satd FROM h""")
def satd(vectors):
    part = lambda at: F.transform(F.slice("embedding", at, 16), component)
    return vectors.select("vec_id", blocks.satd4x4(part(1), part(17)).alias("satd"))


@_query("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], f"""
    SELECT l_orderkey, count(*)::BIGINT AS samples, round(sum(pow({_P} - {_Q} * 5, 2)), 3) AS sse, sum(CASE WHEN {_P} <> {_Q} * 5 THEN 1 ELSE 0 END)::BIGINT AS differing,
        max(abs({_P} - {_Q} * 5))::DOUBLE AS max_diff, round(CASE WHEN sum(pow({_P} - {_Q} * 5, 2)) > 0 THEN 10 * log10(65025.0 * count(*) / sum(pow({_P} - {_Q} * 5, 2))) ELSE 99.0 END, 6) AS psnr FROM lineitem GROUP BY 1""")
def plane_psnr(items):
    out = compare.plane_quality(items, ["l_orderkey"], _price(), _quantity() * 5, cap=99.0)
    return out.select("l_orderkey", "samples", F.round("sse", 3).alias("sse"), "differing", "max_diff", F.round("psnr", 6).alias("psnr"))


@_query("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], f"SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE {_P} % 8 <> {_Q} % 8 GROUP BY 1")
def first_diff(items):
    return compare.first_difference(items, ["l_orderkey"], ["l_linenumber"], _price() % 8 != _quantity() % 8)


@_query("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], f"SELECT l_orderkey, round(avg({_Q}), 6) AS mean_a, round(avg({_P}), 6) AS mean_b, abs(avg({_Q}) - avg({_P})) < 5.0 AS within FROM lineitem GROUP BY 1")
def mean_tol(items):
    out = compare.plane_quality(items, ["l_orderkey"], _quantity(), _price())
    return out.select("l_orderkey", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), (F.abs(F.col("mean_a") - F.col("mean_b")) < 5.0).alias("within"))


@_query("lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], f"SELECT l_orderkey, max(abs({_Q} - 25))::BIGINT AS away, max(abs({_Q} - 25)) <= 3 AS neutral FROM lineitem GROUP BY 1")
def neutral_bound(items):
    return comparators.neutral_bound(items, ["l_orderkey"], _quantity(), middle=25)


_SIDES = """
    WITH a AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v FROM events WHERE event_type <> 'click'),
    b AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN 'view' ELSE event_type END AS event_type, CAST(floor(value) AS BIGINT) + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS v FROM events WHERE event_type <> 'error')"""


def _sides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two traces that differ in some rows and fields."""
    v = F.floor("value")
    a = events.where("event_type != 'click'").select(*EVENT, "event_type", v.alias("v"))
    b = events.where("event_type != 'error'").select(*EVENT, F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type")).alias("event_type"), (v + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)).alias("v"))
    return a, b


@_query("events", [*EVENT, "event_type", "value"], _SIDES + """
    , j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_id, b.event_id) AS event_id, a.event_id IS NULL AS na, b.event_id IS NULL AS nb,
        CASE WHEN a.event_type IS DISTINCT FROM b.event_type THEN 1 ELSE 0 END + CASE WHEN a.v IS DISTINCT FROM b.v THEN 1 ELSE 0 END AS n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_id = b.event_id)
    SELECT user_id, event_id, CASE WHEN na THEN 'missing_left' WHEN nb THEN 'missing_right' WHEN n > 0 THEN 'differs' ELSE 'equal' END AS status, CAST(CASE WHEN na OR nb THEN 0 ELSE n END AS BIGINT) AS n_differing FROM j""")
def trace_diff(events):
    return compare.trace_diff(*_sides(events), EVENT, ["event_type", "v"])


@_query("events", [*EVENT, "event_type", "value"], _SIDES + """
    , x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM b)
    SELECT coalesce(x.user_id, y.user_id) AS user_id, min(coalesce(x.place, y.place))::BIGINT AS place FROM x FULL JOIN y ON x.user_id = y.user_id AND x.place = y.place
    WHERE x.event_type IS DISTINCT FROM y.event_type OR x.v IS DISTINCT FROM y.v GROUP BY 1""")
def first_divergence(events):
    return compare.first_divergence(*_sides(events), "user_id", "event_id", ["event_type", "v"])


@_query("events", [*EVENT, "event_type", "value"], _SIDES + " SELECT user_id, event_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.v = a.v)")
def match_any(events):
    a, b = _sides(events)
    return comparators.match_any(a, b, ["user_id", "v"]).select(*EVENT)


@_query("lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey"], f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, w * h, w, h, vx, vy) AS n FROM (SELECT l_orderkey, l_linenumber AS line, 4 << ({_Q} % 3)::INTEGER AS w, 4 << (l_partkey % 3)::INTEGER AS h, l_partkey // 7 % 3 AS vx, {_Q} % 2 AS vy FROM lineitem)),
    m AS (SELECT *, w * h AS area, max(w * h) OVER (PARTITION BY l_orderkey ORDER BY n) AS top FROM r),
    f AS (SELECT *, first_value([w, h, vx, vy]) OVER (PARTITION BY l_orderkey, area ORDER BY n) AS lead FROM m)
    SELECT l_orderkey, arg_max([w, h, vx, vy], area * 100 - n)[1]::BIGINT AS w, arg_max([w, h, vx, vy], area * 100 - n)[2]::BIGINT AS h, arg_max([w, h, vx, vy], area * 100 - n)[3]::BIGINT AS vx, arg_max([w, h, vx, vy], area * 100 - n)[4]::BIGINT AS vy,
           bool_or(area = top AND [w, h, vx, vy] <> lead) AS ambiguous, sum(area)::BIGINT AS area_sum FROM f GROUP BY 1""")
def repr_mv(items):
    side = lambda c: F.call_function("shiftleft", F.lit(4), c.cast("int"))
    rows = items.select("l_orderkey", "l_linenumber", side(_quantity() % 3).alias("w"), side(F.col("l_partkey") % 3).alias("h"), (F.floor(F.col("l_partkey") / 7) % 3).alias("vx"), (_quantity() % 2).alias("vy"))
    return comparators.representative_block(rows, ["l_orderkey"], "l_linenumber", "w", "h", ["vx", "vy"]).drop("candidates")


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice", "l_partkey"], f"""
    WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, {_P} - 128 AS p, ({_Q} - 25) * 5 AS r, l_partkey % 4 = 0 AS moved FROM lineitem),
    c AS (SELECT *, CASE WHEN moved THEN 'mode' WHEN abs(p) > 2 * abs(r) THEN 'prediction' WHEN abs(r) > 2 * abs(p) THEN 'residual' ELSE 'mixed' END AS kind FROM d)
    SELECT kind, id, p, r, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(p + r) DESC, id) AS place FROM c) WHERE place <= 5""")
def classify_topk(items):
    d = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (_price() - 128).alias("p"), ((_quantity() - 25) * 5).alias("r"), (F.col("l_partkey") % 4 == 0).alias("moved"))
    d = d.withColumn("kind", compare.classify_delta(F.col("p"), F.col("r"), F.col("moved")))
    return compare.top_by_class(d, "kind", F.abs(F.col("p") + F.col("r")), "id", 5).select("kind", "id", "p", "r", "place")


@_query("lineitem", ["l_quantity", "l_extendedprice"], f"""
    WITH s AS (SELECT {_P} // 4 AS x, {_Q} AS y FROM lineitem)
    SELECT x // 4 AS bx, y // 4 AS b_y, count(*)::BIGINT AS n, (SELECT avg(x) FROM s) AS mean_x, (SELECT avg(y) FROM s) AS mean_y FROM s GROUP BY 1, 2""")
def bucket_counts(items):
    rows = items.select(F.floor(_price() / 4).alias("x"), _quantity().alias("y"))
    return comparators.spatial_buckets(rows, "x", "y")


@_query("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice"], f"""
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*)::BIGINT AS n, sum({_Q})::BIGINT AS sum_q, max({_P}) AS max_p, min({_P}) AS min_p, round(avg({_Q}), 6) AS avg_q, count(DISTINCT {_P}) AS n_p FROM lineitem GROUP BY 1, 2, 3""")
def mode_summary(items):
    return items.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.sum(_quantity()).alias("sum_q"), F.max(_price()).alias("max_p"), F.min(_price()).alias("min_p"), F.round(F.avg(_quantity()), 6).alias("avg_q"), F.countDistinct(_price()).alias("n_p"))


@_query("events", [*EVENT, "event_type"], "SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY event_id) AS types FROM events GROUP BY 1")
def type_string(events):
    return compare.type_string(events.withColumn("kind", F.left("event_type", F.lit(1))), ["user_id"], "event_id", "kind")


@_query("events", [*EVENT, "event_type"], "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def type_hist(events):
    return compare.type_histogram(events, ["user_id"], "event_type")


@_query("lineitem", ["l_orderkey", "l_quantity"], "SELECT l_orderkey, n FROM (SELECT l_orderkey, count(DISTINCT l_quantity) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_orderkey LIMIT 10")
def richest(items):
    return comparators.richest(items, ["l_orderkey"], "l_quantity", 10)


@_query("lineitem", [*ITEM, "l_quantity"], f"SELECT l_orderkey, l_linenumber, n::BIGINT AS skipped FROM (SELECT l_orderkey, l_linenumber, unnest(range({_Q} % 4)) AS n FROM lineitem)")
def skip_run(items):
    return sequence.expand_skips(items, _quantity() % 4).select(*ITEM, "skipped")


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice"], f"SELECT l_orderkey, l_linenumber, kind, v FROM (SELECT l_orderkey, l_linenumber, {_Q} AS l0, {_P} AS l1 FROM lineitem) UNPIVOT (v FOR kind IN (l0, l1))")
def mvd_unpivot(items):
    return items.select(*ITEM, _quantity().alias("l0"), _price().alias("l1")).unpivot(ITEM, ["l0", "l1"], "kind", "v")


@_query("events", [*EVENT, "value"], "SELECT user_id, event_id, CASE WHEN p >= 32768 THEN p - 65536 ELSE p END AS poc FROM (SELECT user_id, event_id, CAST(floor(abs(value) * 997) AS BIGINT) % 65536 AS p FROM events)")
def poc_normalise(events):
    p = F.floor(F.abs(F.col("value")) * 997) % 65536
    return events.select(*EVENT, traces.normal_poc(p).alias("poc"))


_AT = f"greatest(0, least(51, {_Q} + l_linenumber - 4)) + 1"


@_query("lineitem", [*ITEM, "l_quantity"], f"""
    WITH t AS (SELECT *, {_AT} AS i FROM lineitem)
    SELECT l_orderkey, l_linenumber, [0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,4,4,5,6,7,8,9,10,12,13,15,17,20,22,25,28,32,36,40,45,50,56,63,71,80,90,101,113,127,144,162,182,203,226,255,255][i]::INT AS alpha,
        CASE WHEN i <= 16 THEN 0 WHEN i <= 26 THEN [2,2,2,3,3,3,3,4,4,4][i - 16] ELSE 6 + (i - 27) // 2 END::INT AS beta,
        (CASE l_linenumber % 4 WHEN 1 THEN [0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,4,5,6,6,7,8,9,10,11,13][i]
            WHEN 2 THEN [0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,5,5,6,7,8,8,10,11,12,13,15,17][i]
            WHEN 3 THEN [0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,1,1,2,2,2,2,3,3,3,4,4,4,5,6,6,7,8,9,10,11,13,14,16,18,20,23,25][i] ELSE 0 END)::INT AS bound FROM t""")
def deblock_limits(items):
    return items.select(*ITEM, *deblock.limits(_quantity(), F.col("l_linenumber") - 4, F.col("l_linenumber") % 4))


@_query("lineitem", [*ITEM, "l_quantity", "l_extendedprice", "l_partkey"], f"""
    WITH d AS (SELECT *, greatest(-128, least(127, 50 - {_Q})) AS tb, greatest(-128, least(127, l_partkey % 100 - {_Q})) AS td FROM lineitem),
    s AS (SELECT *, CASE WHEN td = 0 THEN 256 ELSE greatest(-1024, least(1023, (tb * ((16384 + abs(td // 2)) // nullif(td, 0)) + 32) >> 6)) END AS scale FROM d)
    SELECT l_orderkey, l_linenumber, ((({_P} - 128) * scale + 128) >> 8)::BIGINT AS mv_l0, (((({_P} - 128) * scale + 128) >> 8) - ({_P} - 128))::BIGINT AS mv_l1 FROM s""")
def temporal_direct(items):
    mv = _price() - 128
    first = scalar.temporal_vector(mv, scalar.distance_scale(F.lit(50), _quantity(), F.col("l_partkey") % 100))
    return items.select(*ITEM, first.alias("mv_l0"), (first - mv).alias("mv_l1"))


@_query("events", [*EVENT, "event_type", "value"], f"""
    SELECT user_id, event_id, frame, v FROM (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v,
        last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id {_RUN}) AS frame FROM events) WHERE event_type <> 'signup'""")
def trace_headers(events):
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("frame="), "event_id")).otherwise(F.concat(F.lit("v="), F.floor("value")))
    lines = events.select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return traces.extract_below(lines, {"frame": r"^frame=(\d+)"}, r"^v=(-?\d+)", {"v": "long"}).withColumnsRenamed({"file": "user_id", "line_no": "event_id"})


@_query("events", [*EVENT, "event_type", "value"], """
    WITH k AS (SELECT *, CAST(floor(abs(value) / 20) AS BIGINT) AS n, CAST(floor(value) AS BIGINT) AS p,
        coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM events),
    j AS (SELECT c.user_id, c.event_id, r.event_id AS ref, r.n, r.p, min(r.n) OVER w = max(r.n) OVER w AS one
        FROM k c JOIN k r ON r.user_id = c.user_id AND r.event_type <> 'error' AND r.k >= c.k - 4 AND r.k < c.k WINDOW w AS (PARTITION BY c.user_id, c.event_id))
    SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, CASE WHEN one THEN ref ELSE p END DESC, ref DESC))::INT AS place, ref FROM j""")
def ref_list_p(events):
    pictures = events.select(*EVENT, F.floor(F.abs(F.col("value")) / 20).alias("n"), F.floor("value").alias("p"), "event_type")
    return sequence.reference_list_p(pictures, "user_id", "event_id", "n", "p", F.col("event_type") != "error", 4)
