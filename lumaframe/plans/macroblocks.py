"""Queries over macroblocks and their neighbours. The SQL lays all 4x4 blocks out on the picture's grid and looks neighbours up by their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.operators import neighbours
from lumaframe.plans.comparisons import ITEM, registered, unique_lines, unique_sql

__all__ = ["registered"]  # one register serves both modules

MB = [*ITEM, "l_partkey", "l_suppkey"]
_PLACE = "l_orderkey // 4 AS pic, l_linenumber AS mb_x, l_orderkey % 4 AS mb_y"


def _pictures(items: DataFrame, **columns: Column) -> DataFrame:
    """Four orders make a picture: an order is a row of macroblocks with gaps."""
    return items.select(F.floor(F.col("l_orderkey") / 4).alias("pic"), F.col("l_linenumber").alias("mb_x"), (F.col("l_orderkey") % 4).alias("mb_y"), *[c.alias(n) for n, c in columns.items()])


def _each(n: int, f) -> Column:
    return F.array(*[f(k).cast("int") for k in range(n)])


def _text(*names: str) -> list[Column]:
    return [F.array_join(F.transform(n, lambda v: v.cast("string")), ",").alias(n) for n in names]


def _grid(size: int, value: str) -> str:
    """Blocks of one component as rows: place on the picture's grid, number in the macroblock and value."""
    return f"SELECT {_PLACE}, l_linenumber * {size} + k % {size} AS bx, l_orderkey % 4 * {size} + k // {size} AS b_y, k, {value} AS v FROM (SELECT *, unnest(range({size * size})) AS k FROM lineitem)"


def _around(name: str, made: str, columns: str) -> str:
    return f"""{name} AS (SELECT h.pic, h.mb_x, h.mb_y, {columns} FROM ({made}) h LEFT JOIN ({made}) a ON a.pic = h.pic AND a.bx = h.bx - 1 AND a.b_y = h.b_y
        LEFT JOIN ({made}) b ON b.pic = h.pic AND b.bx = h.bx AND b.b_y = h.b_y - 1 GROUP BY ALL)"""


_MEAN = "CASE WHEN a.v IS NULL AND b.v IS NULL THEN 0 WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE (a.v + b.v + 1) // 2 END"
_FLAGS = "CASE WHEN coalesce(a.v, 1) <> 0 THEN 1 ELSE 0 END + CASE WHEN coalesce(b.v, 1) <> 0 THEN 2 ELSE 0 END"
_BOTH = [(n, f"string_agg({_MEAN}, ',' ORDER BY h.k) AS nc_{n}, string_agg({_FLAGS}, ',' ORDER BY h.k) AS cbf_{n}") for n in ("luma", "cb", "cr")]
_COUNTS = {"luma": (4, "(l_partkey + 3 * k) % 17 * ((l_suppkey + k) % 3)"), "cb": (2, "(l_partkey + k) % 5"), "cr": (2, "(l_suppkey + k) % 3")}


@unique_lines("WITH " + ", ".join(_around(n, _grid(*_COUNTS[n]), columns) for n, columns in _BOTH) + " SELECT * FROM luma JOIN cb USING (pic, mb_x, mb_y) JOIN cr USING (pic, mb_x, mb_y)", lineitem=MB)
def coefficient_contexts(items):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = _pictures(items, luma=_each(16, lambda k: (part + 3 * k) % 17 * ((supp + k) % 3)), cb=_each(4, lambda k: (part + k) % 5), cr=_each(4, lambda k: (supp + k) % 3))
    found = neighbours.coefficient_contexts(rows, ["pic"])
    return found.select("pic", "mb_x", "mb_y", *_text(*[f"{c}_{n}" for n in ("luma", "cb", "cr") for c in ("nc", "cbf")]))


@unique_lines(f"""WITH h AS (SELECT {_PLACE}, l_partkey % 2048 AS cbp, l_suppkey % 7 = 0 AS intra FROM lineitem)
    SELECT h.pic, h.mb_x, h.mb_y, (CASE WHEN a.cbp IS NULL THEN CASE WHEN h.intra THEN 1999 ELSE 15 END ELSE (a.cbp & 2032) | (a.cbp & 2) | (((a.cbp >> 2) & 2) << 2) END)::BIGINT AS left_cbp,
           coalesce(b.cbp, CASE WHEN h.intra THEN 1999 ELSE 15 END)::BIGINT AS top_cbp
    FROM h LEFT JOIN h a ON a.pic = h.pic AND a.mb_x = h.mb_x - 1 AND a.mb_y = h.mb_y LEFT JOIN h b ON b.pic = h.pic AND b.mb_x = h.mb_x AND b.mb_y = h.mb_y - 1""", lineitem=MB)  # fmt: skip
def pattern_contexts(items):
    found = neighbours.pattern_contexts(_pictures(items, cbp=(F.col("l_partkey") % 2048).cast("int"), intra=F.col("l_suppkey") % 7 == 0), ["pic"])
    return found.withColumns({c: F.col(c).cast("long") for c in ("left_cbp", "top_cbp")})


_MODE = "CASE WHEN l_suppkey % 7 = 0 THEN -1 ELSE (l_partkey + k * l_suppkey) % 9 END"
_LEAST = "CASE WHEN coalesce(a.v, -1) < 0 OR coalesce(b.v, -1) < 0 THEN 2 ELSE least(a.v, b.v) END"


@unique_lines("WITH " + _around("m", _grid(4, _MODE), f"string_agg({_LEAST}, ',' ORDER BY h.k) AS predicted, string_agg(CASE WHEN h.v = {_LEAST} THEN -1 WHEN h.v < {_LEAST} THEN h.v ELSE h.v - 1 END, ',' ORDER BY h.k) AS raw") + " SELECT * FROM m", lineitem=MB)
def predicted_modes(items):
    mode = _each(16, lambda k: F.when(F.col("l_suppkey") % 7 == 0, -1).otherwise((F.col("l_partkey") + k * F.col("l_suppkey")) % 9))
    return neighbours.predicted_modes(_pictures(items, mode=mode), ["pic"]).select("pic", "mb_x", "mb_y", *_text("predicted", "raw"))


_SHAPE = "['16x16', '16x8', '8x16', '8x8', 'skip', 'intra'][l_partkey % 6 + 1]"
_OWNER = "CASE shape WHEN '16x8' THEN k // 8 WHEN '8x16' THEN k % 4 // 2 WHEN '8x8' THEN k // 8 * 2 + k % 4 // 2 ELSE 0 END"
_CELLS = f"""cells AS (SELECT *, {_OWNER} AS owner FROM (SELECT {_PLACE}, {_SHAPE} AS shape, l_linenumber * 4 + k % 4 AS cx, l_orderkey % 4 * 4 + k // 4 AS cy, k,
        (l_suppkey + k // 4) % 3 - 1 AS ref, (l_partkey % 5 + k) % 3 * 40 - 40 AS x, l_suppkey % 4 * (k % 5) - 3 AS y FROM (SELECT *, unnest(range(16)) AS k FROM lineitem)))"""


def _looked_up(side: str, x: str, y: str, seen: str) -> str:
    return f"LEFT JOIN cells {side} ON {side}.pic = p.pic AND {side}.cx = {x} AND {side}.cy = {y} AND ({side}.mb_y < p.mb_y OR {side}.mb_y = p.mb_y AND {side}.mb_x < p.mb_x{seen.format(s=side)})"


_SEEN = " OR {s}.mb_y = p.mb_y AND {s}.mb_x = p.mb_x AND {s}.owner < p.part"
_THREE = """coalesce(a.{r}, -2) AS ar{i}, coalesce(a.{x}, 0) AS ah{i}, coalesce(a.{y}, 0) AS av{i}, coalesce(b.{r}, -2) AS br{i}, coalesce(b.{x}, 0) AS bh{i}, coalesce(b.{y}, 0) AS bv{i},
    CASE WHEN c.pic IS NULL THEN coalesce(d.{r}, -2) ELSE c.{r} END AS cr{i}, CASE WHEN c.pic IS NULL THEN coalesce(d.{x}, 0) ELSE c.{x} END AS ch{i}, CASE WHEN c.pic IS NULL THEN coalesce(d.{y}, 0) ELSE c.{y} END AS cv{i}"""


def _vector_sql(v: str) -> str:
    return f"""CASE WHEN shape = 'skip' AND (ar = -2 OR br = -2 OR (ar = 0 AND ah = 0 AND av = 0) OR (br = 0 AND bh = 0 AND bv = 0)) THEN 0
        WHEN shape = '16x8' AND part = 0 AND br = ref THEN b{v} WHEN shape = '16x8' AND part = 1 AND ar = ref THEN a{v} WHEN shape = '8x16' AND part = 0 AND ar = ref THEN a{v} WHEN shape = '8x16' AND part = 1 AND cr = ref THEN c{v}
        WHEN n = 1 AND ar = ref THEN a{v} WHEN n = 1 AND br = ref THEN b{v} WHEN n = 1 THEN c{v} WHEN n = 0 AND br = -2 AND cr = -2 AND ar <> -2 THEN a{v} ELSE list_sort([a{v}, b{v}, c{v}])[2] END"""


@unique_lines(f"""WITH {_CELLS},
    shapes(shape, part, px, py, w) AS (VALUES ('16x16', 0, 0, 0, 4), ('skip', 0, 0, 0, 4), ('16x8', 0, 0, 0, 4), ('16x8', 1, 0, 2, 4), ('8x16', 0, 0, 0, 2), ('8x16', 1, 2, 0, 2), ('8x8', 0, 0, 0, 2), ('8x8', 1, 2, 0, 2), ('8x8', 2, 0, 2, 2), ('8x8', 3, 2, 2, 2)),
    parts AS (SELECT c.pic, c.mb_x, c.mb_y, c.shape, part, w, c.cx AS gx, c.cy AS gy, CASE WHEN c.shape = 'skip' THEN 0 ELSE c.ref END AS ref, c.x AS vx, c.y AS vy FROM cells c JOIN shapes s ON s.shape = c.shape AND c.k = s.py * 4 + s.px),
    seen AS (SELECT p.*, {_THREE.format(r='ref', x='x', y='y', i='')} FROM parts p {_looked_up('a', 'p.gx - 1', 'p.gy', _SEEN)} {_looked_up('b', 'p.gx', 'p.gy - 1', _SEEN)} {_looked_up('c', 'p.gx + p.w', 'p.gy - 1', _SEEN)} {_looked_up('d', 'p.gx - 1', 'p.gy - 1', _SEEN)}),
    counted AS (SELECT *, (ar = ref)::INTEGER + (br = ref)::INTEGER + (cr = ref)::INTEGER AS n FROM seen),
    done AS (SELECT *, {_vector_sql('h')} AS pred_x, {_vector_sql('v')} AS pred_y FROM counted)
    SELECT pic, mb_x, mb_y, part, ref::INTEGER AS ref, pred_x::INTEGER AS pred_x, pred_y::INTEGER AS pred_y, (vx - pred_x)::INTEGER AS diff_x, (vy - pred_y)::INTEGER AS diff_y FROM done""", lineitem=MB)  # fmt: skip
def vector_prediction(items):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    shape = F.get(F.array(*map(F.lit, ["16x16", "16x8", "8x16", "8x8", "skip", "intra"])), (part % 6).cast("int"))
    rows = _pictures(items, shape=shape, ref=_each(16, lambda k: (supp + k // 4) % 3 - 1), x=_each(16, lambda k: (part % 5 + k) % 3 * 40 - 40), y=_each(16, lambda k: supp % 4 * (k % 5) - 3))
    return neighbours.predict_vectors(rows, ["pic"])


_DIRECT = f"""cells AS (SELECT {_PLACE}, l_partkey, l_suppkey, l_linenumber * 4 + k % 4 AS cx, l_orderkey % 4 * 4 + k // 4 AS cy, k, l_suppkey % 4 - 1 AS ref0, l_partkey % 3 - 1 AS ref1,
        l_partkey % 4 - 1 + k % 4 // 2 * (l_suppkey % 2) AS x0, l_suppkey % 3 - 1 AS y0, l_suppkey % 4 - 1 AS x1, l_partkey % 3 - 1 + k // 8 * (l_partkey % 2) AS y1, 0 AS owner FROM (SELECT *, unnest(range(16)) AS k FROM lineitem))"""


def _direct_sql(i: int) -> str:
    """Reference and vector of one list from the three neighbours."""
    best = f"list_min(list_filter([ar{i}, br{i}, cr{i}], lambda r: r >= 0))"
    vector = lambda v: f"CASE WHEN best{i} IS NULL THEN 0 WHEN (ar{i} = best{i})::INTEGER + (br{i} = best{i})::INTEGER + (cr{i} = best{i})::INTEGER > 1 THEN list_sort([a{v}{i}, b{v}{i}, c{v}{i}])[2] WHEN ar{i} = best{i} THEN a{v}{i} WHEN br{i} = best{i} THEN b{v}{i} ELSE c{v}{i} END"
    before = "three" if i == 0 else "list0"
    return f"list{i} AS (SELECT *, {vector('h')} AS x{i}, {vector('v')} AS y{i} FROM (SELECT *, {best} AS best{i} FROM {before}))"


@registered.query(unique_sql(f"""WITH {_DIRECT},
    three AS (SELECT p.pic, p.mb_x, p.mb_y, {_THREE.format(r='ref0', x='x0', y='y0', i='0')}, {_THREE.format(r='ref1', x='x1', y='y1', i='1')}
        FROM cells p {_looked_up('a', 'p.cx - 1', 'p.cy', '')} {_looked_up('b', 'p.cx', 'p.cy - 1', '')} {_looked_up('c', 'p.cx + 4', 'p.cy - 1', '')} {_looked_up('d', 'p.cx - 1', 'p.cy - 1', '')} WHERE p.k = 0 AND p.l_partkey % 2 = 0),
    {_direct_sql(0)}, {_direct_sql(1)},
    inferred AS (SELECT pic, mb_x, mb_y, CASE WHEN best0 IS NULL AND best1 IS NULL THEN 0 ELSE coalesce(best0, -1) END AS ref0, CASE WHEN best0 IS NULL AND best1 IS NULL THEN 0 ELSE coalesce(best1, -1) END AS ref1, x0, y0, x1, y1 FROM list1),
    corner AS (SELECT pic + 1 AS pic, mb_x, mb_y, k % 4 // 2 + k // 8 * 2 AS quarter, l_suppkey % 7 = 0 AS intra, l_partkey % 4 < 2 AS whole, CASE WHEN ref0 < 0 THEN [ref1, x1, y1] ELSE [ref0, x0, y0] END AS v FROM cells WHERE k IN (0, 3, 12, 15)),
    moved AS (SELECT pic, mb_x, mb_y, any_value(intra) AS intra, any_value(whole) AND count(DISTINCT v) = 1 AS one, list(v ORDER BY quarter) AS v FROM corner GROUP BY 1, 2, 3),
    quarters AS (SELECT i.*, quarter, coalesce(NOT m.intra AND b[1] = 0 AND abs(b[2]) <= 1 AND abs(b[3]) <= 1, FALSE) AS still
        FROM (SELECT *, unnest(range(4)) AS quarter FROM inferred) i LEFT JOIN moved m USING (pic, mb_x, mb_y), LATERAL (SELECT m.v[CASE WHEN m.one THEN 1 ELSE quarter + 1 END] AS b))
    SELECT pic, mb_x, mb_y, quarter::INTEGER AS quarter, still, ref0::INTEGER AS ref0, ref1::INTEGER AS ref1, (CASE WHEN still AND ref0 = 0 THEN 0 ELSE x0 END)::INTEGER AS x0, (CASE WHEN still AND ref0 = 0 THEN 0 ELSE y0 END)::INTEGER AS y0,
           (CASE WHEN still AND ref1 = 0 THEN 0 ELSE x1 END)::INTEGER AS x1, (CASE WHEN still AND ref1 = 0 THEN 0 ELSE y1 END)::INTEGER AS y1 FROM quarters""", MB), lineitem=MB)  # fmt: skip
def spatial_direct(items):
    # Lines are dealt by picture before they are made unique, so neither that nor their neighbours take another shuffle.
    lines = _pictures(items, part=F.col("l_partkey"), supp=F.col("l_suppkey")).repartition("pic").groupBy("pic", "mb_x", "mb_y").agg(F.min("part").alias("part"), F.min("supp").alias("supp"))
    part, supp = F.col("part"), F.col("supp")
    columns = {"direct": part % 2 == 0, "intra": supp % 7 == 0, "ref0": _each(16, lambda k: supp % 4 - 1), "ref1": _each(16, lambda k: part % 3 - 1), "y0": _each(16, lambda k: supp % 3 - 1), "x1": _each(16, lambda k: supp % 4 - 1)}
    columns |= {"x0": _each(16, lambda k: part % 4 - 1 + k % 4 // 2 * (supp % 2)), "y1": _each(16, lambda k: part % 3 - 1 + k // 8 * (part % 2))}
    rows = lines.select("pic", "mb_x", "mb_y", *[c.alias(n) for n, c in columns.items()])
    return neighbours.spatial_direct(rows.withColumn("col", F.col("pic") - 1), rows, ["pic"], ["col"])
