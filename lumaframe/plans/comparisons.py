"""Queries of the trace comparators, edge strengths, 8x8 blocks and syntax rules.

Both sides of a comparison are made of one table's columns, with changes and
gaps. The SQL states the same in rows, joins and tables typed out, not from
this library's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions import blocks, deblock, scalar, syntax
from lumaframe.operators import comparators, sequence
from lumaframe.plans.register import Register, component

registered = Register()

ITEM = ["l_orderkey", "l_linenumber"]
TRACE = [*ITEM, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_Q = "CAST(floor(l_quantity) AS BIGINT)"
_P = "CAST(floor(l_extendedprice) AS BIGINT) % 256"


def _part() -> Column:
    return F.col("l_partkey")


def _supp() -> Column:
    return F.col("l_suppkey")


def _quantity() -> Column:
    return F.floor("l_quantity")


def _price() -> Column:
    return F.floor("l_extendedprice") % 256


def unique_sql(sql: str, columns: list[str]) -> str:
    """A statement in which ``lineitem`` stands for its rows made unique by order and line, as a trace's keys are."""
    least = ", ".join(f"min({c}) AS {c}" for c in columns if c not in ITEM)
    rest = sql.strip().replace("FROM lineitem", "FROM mb")
    return f"WITH mb AS (SELECT {', '.join(ITEM)}, {least} FROM lineitem GROUP BY ALL)" + (f", {rest[4:]}" if rest.startswith("WITH") else f" {rest}")


def unique_lines(sql: str, **tables: list[str]):
    """Register a query of such rows."""
    if "lineitem" not in tables:
        return registered.query(sql, **tables)
    sql = unique_sql(sql, tables["lineitem"])

    def keep(f: Callable[..., DataFrame]) -> Callable:
        def unique(*frames: DataFrame) -> DataFrame:
            return f(*[d.groupBy(*ITEM).agg(*[F.min(c).alias(c) for c in d.columns if c not in ITEM]) if "l_orderkey" in d.columns else d for d in frames])

        unique.__name__ = f.__name__
        return registered.query(sql, **tables)(unique)

    return keep


def one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def _one(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


_BLOCKS = """
    b AS (SELECT l_orderkey AS k, l_linenumber AS line, 8 + 8 * (l_suppkey % 2) AS w, 8 + 8 * (l_partkey % 2) AS h, l_partkey % 3 AS x, l_suppkey % 2 AS y FROM lineitem),
    m AS (SELECT *, w * h AS area, max(w * h) OVER (PARTITION BY k ORDER BY line) AS top, first_value(x) OVER (PARTITION BY k, w * h ORDER BY line) AS lx, first_value(y) OVER (PARTITION BY k, w * h ORDER BY line) AS ly, first_value(w) OVER (PARTITION BY k, w * h ORDER BY line) AS lw FROM b),
    f AS (SELECT k, arg_max(struct_pack(w := w, h := h, x := x, y := y), struct_pack(area := area, n := -line)) AS r, bool_or(area = top AND (x <> lx OR y <> ly OR w <> lw)) AS ambiguous, sum(area) AS covered, count(*) AS n FROM m GROUP BY k),
    o AS (SELECT o_orderkey AS k, o_orderstatus AS kind, o_custkey % 3 AS x, o_custkey % 2 AS y FROM orders)"""


def _vectors(orders: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    ours = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 3).alias("mvx"), (F.col("o_custkey") % 2).alias("mvy"))
    theirs = items.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), (8 + 8 * (_supp() % 2)).alias("w"), (8 + 8 * (_part() % 2)).alias("h"), (_part() % 3).alias("mvx"), (_supp() % 2).alias("mvy"))
    return ours, theirs


@unique_lines(f"""WITH {_BLOCKS}
    SELECT k, CASE WHEN ambiguous THEN 'skipped_ambiguous' WHEN EXISTS (SELECT 1 FROM b WHERE b.k = f.k AND b.x = o.x AND b.y = o.y) THEN 'match' ELSE 'mismatch' END AS outcome, n::BIGINT AS n_candidates
    FROM o JOIN f USING (k) WHERE kind <> 'P'""", orders=["o_orderkey", "o_custkey", "o_orderstatus"], lineitem=[*ITEM, "l_partkey", "l_suppkey"])  # fmt: skip
def vector_diff(orders, items):
    return comparators.vector_diff(*_vectors(orders, items), ["k"], "line", "kind", skip_kinds=("P",), match_any=True)


@unique_lines(f"""WITH {_BLOCKS},
    c AS (SELECT kind, CASE WHEN r.w <> 16 OR r.h <> 16 THEN 's' WHEN covered <> 256 THEN 'c' WHEN r.x = o.x AND r.y = o.y THEN 'm' ELSE 'd' END AS how FROM o JOIN f USING (k))
    SELECT count(*) FILTER (WHERE how = 'd') AS mismatches, count(*) FILTER (WHERE how IN ('m', 'd')) AS compared, 0::BIGINT AS skipped_ambiguous, count(*) FILTER (WHERE how = 's') AS skipped_size, count(*) FILTER (WHERE how = 'c') AS skipped_coverage FROM c""",
    orders=["o_orderkey", "o_custkey", "o_orderstatus"], lineitem=[*ITEM, "l_partkey", "l_suppkey"])
def vector_counts(orders, items):
    return comparators.outcome_counts(comparators.vector_diff(*_vectors(orders, items), ["k"], "line", "kind", only_unambiguous=False, full_block=True, full_cover=True))


def _status(found: str, names: list[tuple[str, str]]) -> str:
    fields = "concat_ws(',', " + ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in names) + ")"
    return f"CASE WHEN NOT ({found}) THEN 'missing' WHEN {fields} <> '' THEN 'differs' ELSE 'equal' END AS status, CASE WHEN {found} THEN {fields} ELSE '' END AS fields"


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))


def _four(f) -> Column:
    return F.array(*[f(k) for k in range(4)])


@unique_lines(f"""
    WITH s AS (SELECT *, unnest(range(4)) AS k FROM lineitem),
    v AS (SELECT l_orderkey, l_linenumber, [12552, 20744, 61704, 64, 8][(l_partkey + k) % 5 + 1] AS sa, [12552, 20744, 61704, 64, 8][(l_partkey + k + {_one('l_suppkey % 3 = 0')}) % 5 + 1] AS sb,
        (l_suppkey + k) % 4 AS ma, (l_suppkey + k + {_one('l_partkey % 5 = 0')}) % 4 AS mb FROM s),
    d AS (SELECT l_orderkey, l_linenumber, bool_or(sa > 100 AND sb > 100 AND ma <> mb) AS m, bool_or(NOT (sa > 100 AND sb > 100) AND sa <> sb) AS t FROM v GROUP BY 1, 2),
    j AS (SELECT *, l_linenumber % 3 - 1 AS pa, (l_linenumber + {_one('l_suppkey % 13 = 0')}) % 3 - 1 AS pb FROM lineitem JOIN d USING (l_orderkey, l_linenumber))
    SELECT l_orderkey, l_linenumber, {_status('l_partkey % 11 <> 0', [('spatial', 'pa >= 0 AND pb >= 0 AND pa <> pb'), ('ref_mv', 'l_partkey % 7 = 0'), ('sub', 't'), ('submv', 'm')])} FROM j""", lineitem=TRACE)  # fmt: skip
def direct_diff(items):
    flags = [12552, 20744, 61704, 64, 8]

    def side(rows: DataFrame, sub: Column, mv: Column, ref: Column, spatial: Column) -> DataFrame:
        return rows.select(*ITEM, ((F.col("l_linenumber") + spatial) % 3 - 1).alias("spatial"), F.array(_part() % 3 - 1, _quantity() - 25 + ref, _price() - 128).alias("ref_mv"), _four(lambda k: _pick(flags, _part() + k + sub)).alias("sub"), _four(lambda k: (_supp() + k + mv) % 4).alias("submv"))

    zero = F.lit(0)
    left, right = side(items, zero, zero, zero, zero), side(items.where(_part() % 11 != 0), one(_supp() % 3 == 0), one(_part() % 5 == 0), one(_part() % 7 == 0), one(_supp() % 13 == 0))
    return comparators.direct_diff(left, right, ITEM, with_sub=True).select(*ITEM, "status", "fields")


_FLAGS = [8 + 4096 + 16384, 16 + 4096 + 8192, 64 + 4096, 32 + 4096 + 32768, 1, 8 + 256 + 61440]
_CELLS = [12552, 61704, 49416, 4160, 16448]


def _bidi_sql() -> str:
    """List use typed out by type; motion as rows of (list, part)."""
    second = "(l_linenumber % 2)"
    sub = lambda k, more: f"[12552, 61704, 49416, 4160, 16448][(l_partkey + {k} * {second} + {more}) % 5 + 1]"
    shift = _one("l_suppkey % 3 = 0")
    quarters = ", ".join(f"{sub(k, 0)} AS a{k}, {sub(k, shift)} AS b{k}" for k in range(4))
    mv = {
        (0, 0): ("l_partkey % 3 - 1", _Q, "l_partkey % 2", f"{_Q} + {_one('l_partkey % 4 = 0')}"),
        (1, 0): ("l_suppkey % 3 - 1", "l_partkey % 5", "l_suppkey % 5", f"l_partkey % 5 + {_one('l_suppkey % 4 = 0')}"),
        (0, 1): ("l_suppkey % 3 - 1", _P, "l_suppkey % 2", f"{_P} + {_one('l_partkey % 5 = 0')}"),
        (1, 1): ("l_partkey % 3 - 1", "l_suppkey % 5", "l_partkey % 5", f"l_suppkey % 5 + {_one('l_suppkey % 6 = 0')}"),
    }
    use = {0: [(1, 1), (1, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 0), (0, 0), (1, 0), (1, 0), (0, 1), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (1, 1), (1, 1), (1, 0), (1, 0), (1, 1), (1, 1)],
           1: [(1, 1), (0, 0), (1, 0), (1, 0), (0, 0), (0, 0), (1, 1), (1, 1), (0, 1), (0, 1), (1, 0), (1, 0), (0, 1), (0, 1), (1, 1), (1, 1), (1, 0), (1, 0), (1, 1), (1, 1), (1, 1), (1, 1)]}
    mask, bits = {0: 12288, 1: 49152}, {(0, 0): 4096, (0, 1): 8192, (1, 0): 16384, (1, 1): 32768}

    def left(w: int, p: int) -> str:
        own = f"ta & {bits[w, min(p, 1)]} <> 0"
        return f"(CASE WHEN ta & 64 <> 0 THEN a{p} & {mask[w]} <> 0 " + (f"WHEN ta & 8 <> 0 THEN ta & {bits[w, 0]} <> 0 " if p == 1 else "") + f"ELSE {own} END)"

    def right(w: int, p: int) -> str:
        table = [u[0 if p == 0 or (p == 1 and t < 4) else 1] for t, u in enumerate(use[w])]
        return f"(CASE WHEN tb = 22 THEN b{p} & {mask[w]} <> 0 ELSE {table}[tb + 1] = 1 END)"

    def motion(p: int) -> str:
        return " OR ".join(f"((d{w}{p}) AND ({left(w, p)} <> {right(w, p)} OR ({left(w, p)} AND NOT (r{w}{p} < 0))))" for w in (0, 1))

    direct = " AND ".join(f"{s}{k} IN (12552, 61704, 49416)" for s in "ab" for k in range(4))
    plain = lambda s, k: f"CASE WHEN {s}{k} IN (12552, 61704, 49416) THEN 0 ELSE {s}{k} END"
    same = " AND ".join(f"{plain('a', k)} = {plain('b', k)}" for k in range(4))
    moved = ", ".join(f"({v} <> {w}) AS d{which}{part}, {r} AS r{which}{part}" for (which, part), (r, v, _, w) in mv.items())
    diff = {0: "(d00 OR d10)", 1: "(d01 OR d11)"}
    submv = "l_partkey % 8 = 0"
    names = [
        ("ref_mv", f"NOT (({direct}) AND NOT {diff[1]} AND NOT ({submv})) AND ({motion(0)})"),
        ("p1", f"NOT (({direct}) AND NOT {diff[0]} AND NOT ({submv})) AND ({motion(1)})"),
        ("sub", f"({' OR '.join(f'a{k} & 64 <> 0' for k in range(4))} OR tb = 22) AND NOT ({same}) AND ({diff[0]} OR {diff[1]} OR {submv})"),
        ("submv", f"({submv}) AND ({' OR '.join(f'(a{k} IN (12552, 61704, 49416) AND b{k} IN (12552, 61704, 49416) AND {left(0, k)} AND {right(0, k)})' for k in range(4))})"),
    ]
    return f"""WITH r AS (SELECT *, {_FLAGS}[l_partkey % 6 + 1] AS ta, l_suppkey % 23 AS tb, {quarters}, {moved} FROM lineitem)
        SELECT l_orderkey, l_linenumber, {_status('l_partkey % 11 <> 0', names)} FROM r WHERE ta & 7 = 0"""


@unique_lines(_bidi_sql(), lineitem=TRACE)
def bidi_diff(items):
    second = F.col("l_linenumber") % 2

    def side(rows: DataFrame, kind: Column, right: bool) -> DataFrame:
        more = lambda c: one(c) if right else F.lit(0)
        sub = _four(lambda k: _pick(_CELLS, _part() + k * second + more(_supp() % 3 == 0)))
        ref_mv = F.array(_part() % 3 - 1, _supp() % 3 - 1, _quantity() + more(_part() % 4 == 0), _price(), _part() % 5 + more(_supp() % 4 == 0), _supp() % 5)
        p1 = F.array(_supp() % 3 - 1, _part() % 3 - 1, _price() + more(_part() % 5 == 0), _quantity(), _supp() % 5 + more(_supp() % 6 == 0), _part() % 5)
        return rows.select(*ITEM, kind.alias("mbtype"), ref_mv.alias("ref_mv"), p1.alias("p1"), sub.alias("sub"), _four(lambda k: _supp() + k + more(_part() % 8 == 0)).alias("submv"))

    return comparators.bidi_diff(side(items, _pick(_FLAGS, _part()), False), side(items.where(_part() % 11 != 0), _supp() % 23, True), ITEM).select(*ITEM, "status", "fields")


def _events(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["user_id", "event_id"]
    v = F.floor("value")
    left = rows.where("event_type != 'click'").select(*keys, F.col("event_type").alias("kind"), (v % 50).alias("range"), (v % 7).alias("low"))
    right = rows.where("event_id % 9 != 0").select(*keys, F.when(F.col("event_id") % 7 == 0, "view").otherwise(F.col("event_type")).alias("kind"), (v % 50 + one(F.col("event_id") % 5 == 0)).alias("range"), (v % 7 + one(F.col("event_id") % 4 == 0)).alias("low"))
    return left, right


@unique_lines(f"SELECT user_id, event_id, {_status('event_id % 9 <> 0', [('kind', 'event_id % 7 = 0 AND event_type <> chr(118) || chr(105) || chr(101) || chr(119)'), ('range', 'event_id % 5 = 0'), ('low', 'event_id % 4 = 0')])} FROM events WHERE event_type <> 'click'", events=["user_id", "event_id", "event_type", "value"])
def state_diff(events):
    return comparators.state_diff(*_events(events), ["user_id", "event_id"], with_low=True).select("user_id", "event_id", "status", "fields")


@unique_lines(f"""
    WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, part, list FROM lineitem, (VALUES (0), (1)) a(part), (VALUES (0), (1)) b(list)),
    v AS (SELECT *, (l_partkey + 2 * list + part) % 7 AS da, (l_partkey + 2 * list + part + {_one('l_suppkey % 4 = 0 AND list = 1')}) % 7 AS db, (l_suppkey + list) % 5 AS pa, (l_suppkey + list + {_one('l_partkey % 6 = 0 AND part = 1')}) % 5 AS pb FROM s)
    SELECT l_orderkey, l_linenumber, part, list, {_status('l_partkey % 11 <> 0', [('mvd', 'da <> db'), ('mvp', 'pa <> pb'), ('final', 'da + pa <> db + pb')])} FROM v""", lineitem=TRACE)  # fmt: skip
def partition_diff(items):
    mvd = lambda which, part, more=0: (_part() + 2 * which + part + more) % 7
    mvp = lambda which, part, more=0: (_supp() + which + more) % 5
    left = comparators.partition_vectors(items.select(*ITEM, *[x.alias(f"{n}{w}{'p1' if p else ''}") for w in (0, 1) for p in (0, 1) for n, x in (("mvd", mvd(w, p)), ("mvp", mvp(w, p)), ("final", mvd(w, p) + mvp(w, p)))]), ITEM, ["mvd", "mvp", "final"])
    changed = {(w, p): (mvd(w, p, one(_supp() % 4 == 0) * w), mvp(w, p, one(_part() % 6 == 0) * p)) for w in (0, 1) for p in (0, 1)}
    wide = items.where(_part() % 11 != 0).select(*ITEM, *[x.alias(f"{n}{w}{'p1' if p else ''}") for (w, p), (d, v) in changed.items() for n, x in (("mvd", d), ("mvp", v), ("final", d + v))])
    return comparators.partition_diff(left, wide, ITEM).select(*ITEM, "part", "list", "status", "fields")


_RAW = ["amvd", "pre_low", "pre_range", "mvd", "post_range", "post_low"]


def _nth(side: str, keep: str, seen: int, **values: str) -> str:
    """A side's rows with so many rows of their key before them."""
    columns = ", ".join(f"{v} AS {n}" for n, v in values.items())
    return f"{side} AS (SELECT * FROM (SELECT l_orderkey AS mb, l_partkey % 2 AS part, l_suppkey % 2 AS list, {columns}, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 2, l_suppkey % 2 ORDER BY l_linenumber) - 1 AS seen FROM lineitem WHERE {keep}) WHERE seen = {seen})"


@unique_lines(f"""WITH {_nth("l", "TRUE", 1, amvd=f"[{_Q} % 5, {_P} % 3]", mvd=f"[{_P} % 7, {_Q} % 4]", pre_low=_P, pre_range=_Q, post_low="l_suppkey % 9", post_range="l_partkey % 9")},
    {_nth("r", "l_linenumber % 5 < 4", 1, amvd=f"[{_Q} % 5, ({_P} + {_one('l_suppkey % 3 = 0')}) % 3]", mvd=f"[{_P} % 7, {_Q} % 4]", pre_low=f"{_P} + 1", pre_range=_Q, post_low="l_suppkey % 9", post_range=f"(l_partkey + {_one('l_partkey % 4 = 0')}) % 9")}
    SELECT mb, part, list, {_status('r.seen IS NOT NULL', [(n, f'l.{n} <> r.{n}') for n in _RAW])} FROM l LEFT JOIN r USING (mb, part, list)""", lineitem=TRACE)  # fmt: skip
def raw_partition_diff(items):
    def side(more: Column, low: int, range_more: Column) -> DataFrame:
        fields = {"amvd": F.array(_quantity() % 5, (_price() + more) % 3), "mvd": F.array(_price() % 7, _quantity() % 4), "pre_low": _price() + low, "pre_range": _quantity(), "post_low": _supp() % 9, "post_range": (_part() + range_more) % 9}
        return items.select(F.col("l_orderkey").alias("mb"), (_part() % 2).alias("part"), (_supp() % 2).alias("list"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 5).alias("poc"), *[v.alias(n) for n, v in fields.items()])

    right = side(one(_supp() % 3 == 0), 1, one(_part() % 4 == 0)).where("poc < 4")
    return comparators.raw_partition_diff(side(F.lit(0), 0, F.lit(0)), right, ["mb", "part", "list"], "line", occurrences=(1, 1), with_low=True).select("mb", "part", "list", "status", "fields")


_MOTION = f"[l_partkey % 2, {_Q} % 4 - 1, {_P} % 4 - 1]"
_COLZERO = f"""
    l AS (SELECT l_orderkey AS k, l_linenumber AS n, {_MOTION} AS v FROM lineitem),
    r AS (SELECT l_orderkey AS k, l_linenumber AS n, [l_partkey % 2, ({_Q} + {_one('l_suppkey % 3 = 0')}) % 4 - 1, {_P} % 4 - 1] AS v, l_suppkey % 2 = 0 AS zero FROM lineitem WHERE l_linenumber % 4 <> 3)"""
_ZERO = "CASE WHEN abs(l.v[2]) <= 1 AND abs(l.v[3]) <= 1 THEN TRUE ELSE FALSE END"


def _colocated(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    motion = lambda more: F.array(_part() % 2, (_quantity() + more) % 4 - 1, _price() % 4 - 1).alias("ref_mv")
    left = items.select("l_orderkey", F.col("l_linenumber").alias("n"), motion(F.lit(0)))
    right = items.where("l_linenumber % 4 != 3").select("l_orderkey", F.col("l_linenumber").alias("n"), motion(one(_supp() % 3 == 0)), (_supp() % 2 == 0).alias("zero"))
    return left, right


@unique_lines(f"WITH {_COLZERO} SELECT l.k AS l_orderkey, l.n, {_status('r.k IS NOT NULL', [('zero', f'{_ZERO} <> r.zero'), ('motion', f'{_ZERO} = r.zero AND l.v <> r.v')])} FROM l LEFT JOIN r ON l.k = r.k AND l.n = r.n", lineitem=TRACE)
def colocated_zero(items):
    return comparators.colocated_zero_diff(*_colocated(items), ["l_orderkey"], "n").select("l_orderkey", "n", "status", "fields")


@unique_lines(f"""WITH {_COLZERO}, c AS (SELECT l.k, l.n, arg_min(struct_pack(v := r.v, zero := r.zero), CASE WHEN r.v = l.v THEN 0 ELSE 100 END + r.n) AS r FROM l JOIN r ON l.k = r.k GROUP BY l.k, l.n)
    SELECT l.k AS l_orderkey, l.n, {_status('c.k IS NOT NULL', [('zero', f'{_ZERO} <> c.r.zero'), ('motion', f'{_ZERO} = c.r.zero AND l.v <> c.r.v')])} FROM l LEFT JOIN c ON l.k = c.k AND l.n = c.n WHERE abs(l.v[2]) <= 1 AND abs(l.v[3]) <= 1""", lineitem=TRACE)  # fmt: skip
def colocated_zero_any(items):
    return comparators.colocated_zero_diff(*_colocated(items), ["l_orderkey"], "n", any_occurrence=True, only_small=True).select("l_orderkey", "n", "status", "fields")


@unique_lines(f"""WITH l AS (SELECT DISTINCT l_orderkey AS k, [l_partkey % 2, {_Q} % 2] AS v FROM lineitem), r AS (SELECT o_orderkey AS k, [o_custkey % 2, o_orderkey % 2] AS v FROM orders WHERE o_custkey % 5 <> 0)
    SELECT l.k, l.v[1] AS ref, l.v[2] AS x, {_status('r.k IS NOT NULL', [('ref_mv', 'l.v <> r.v')])} FROM l LEFT JOIN r ON l.k = r.k""", lineitem=TRACE, orders=["o_orderkey", "o_custkey"])  # fmt: skip
def saved_motion(items, orders):
    left = items.select(F.col("l_orderkey").alias("k"), "l_linenumber", F.array(_part() % 2, _quantity() % 2).alias("ref_mv"))
    saved = orders.where("o_custkey % 5 != 0").select(F.col("o_orderkey").alias("k"), F.array(F.col("o_custkey") % 2, F.col("o_orderkey") % 2).alias("ref_mv"))
    return comparators.saved_motion_diff(left, saved, ["k"], "l_linenumber").select("k", F.get("a_ref_mv", F.lit(0)).alias("ref"), F.get("a_ref_mv", F.lit(1)).alias("x"), "status", "fields")


@unique_lines(f"""WITH v AS (SELECT *, l_partkey % 5 AS d, (l_partkey + {_one('l_suppkey % 4 = 0')}) % 5 AS m, (l_partkey + {_one('l_suppkey % 6 = 0')}) % 5 AS s, (l_partkey + {_one('l_suppkey % 7 = 0')}) % 5 AS t FROM lineitem WHERE l_partkey % 11 <> 0)
    SELECT l_orderkey, l_linenumber, CASE WHEN CASE WHEN l_partkey % 3 = 0 THEN m <> t ELSE m <> d OR s <> d END THEN 'differs' ELSE 'equal' END AS status FROM v""", lineitem=TRACE)  # fmt: skip
def write_back(items):
    at = [F.col("l_orderkey"), F.col("l_linenumber").alias("part")]
    mv = lambda c: F.array((_part() + one(c)) % 5)
    direct = items.select(*at, mv(F.lit(False)).alias("dmv"))
    written = items.where(_part() % 11 != 0).select(*at, mv(_supp() % 4 == 0).alias("mv0"), mv(_supp() % 6 == 0).alias("sub0"))
    third = items.where(_part() % 3 == 0).select(*at, mv(_supp() % 7 == 0).alias("mv"))
    return comparators.write_back_diff(direct, written, ["l_orderkey"], third).select("l_orderkey", F.col("part").alias("l_linenumber"), "status")


@unique_lines(f"SELECT l_orderkey, l_linenumber, {_status('TRUE', [('pred', 'l_suppkey % 4 = 0'), ('mode', 'l_suppkey % 6 = 0')])}, (-{_one('l_suppkey % 4 = 0')})::BIGINT AS pred_delta, (-{_one('l_suppkey % 6 = 0')})::BIGINT AS mode_delta FROM lineitem WHERE l_partkey % 11 <> 0", lineitem=TRACE)
def mode_diff_8x8(items):
    left = items.select(*ITEM, (_part() % 9).alias("pred"), (_part() % 7).alias("mode"))
    right = items.where(_part() % 11 != 0).select(*ITEM, (_part() % 9 + one(_supp() % 4 == 0)).alias("pred"), (_part() % 7 + one(_supp() % 6 == 0)).alias("mode"))
    return comparators.mode_diff(left, right, ITEM).select(*ITEM, "status", "fields", "pred_delta", "mode_delta")


@unique_lines("""WITH r AS (SELECT l_orderkey AS k, 2 * l_linenumber AS b, l_partkey % 4 AS p, l_suppkey % 4 AS m FROM lineitem)
    SELECT k, count(*)::BIGINT AS n_blocks, count(*) FILTER (WHERE b < 16 AND (m <> (o_custkey + b) % 4 OR (o_custkey % 3 <> 0 AND p <> (o_custkey + 2 * b) % 4)))::BIGINT AS n_differing FROM orders JOIN r ON k = o_orderkey GROUP BY 1""",
    orders=["o_orderkey", "o_custkey"], lineitem=TRACE)
def mode_diff_4x4(orders, items):
    cust = F.col("o_custkey")
    left = orders.select(F.col("o_orderkey").alias("k"), F.array(*[(cust + i) % 4 for i in range(16)]).alias("mode"), F.when(cust % 3 != 0, F.array(*[(cust + 2 * i) % 4 for i in range(16)])).otherwise(F.array().cast("array<bigint>")).alias("pred"))
    right = items.select(F.col("l_orderkey").alias("k"), (2 * F.col("l_linenumber")).cast("int").alias("block"), (_part() % 4).alias("pred"), (_supp() % 4).alias("mode"))
    return comparators.mode_array_diff(left, right, ["k"])


_RECON = f"""r AS (SELECT l_orderkey, l_linenumber, l_partkey % 9 AS ma, (l_partkey + {_one('l_suppkey % 10 = 0')}) % 9 AS mb, {_Q} - l_suppkey % 5 AS out_delta, 3 - {_Q} % 7 AS pred_delta, 4 * (l_partkey % 3) AS top_delta FROM lineitem WHERE l_partkey % 11 <> 0),
    e AS (SELECT *, out_delta - pred_delta AS res_delta FROM r),
    c AS (SELECT *, CASE WHEN ma <> mb THEN 'mode' WHEN abs(pred_delta) > 2 * abs(res_delta) THEN 'prediction' WHEN abs(res_delta) > 2 * abs(pred_delta) THEN 'residual' ELSE 'mixed' END AS kind FROM e)"""


def _recon(items: DataFrame) -> DataFrame:
    side = lambda rows, mode, out, pred, top: rows.select(*ITEM, mode.alias("mode"), out.alias("out"), pred.alias("pred"), F.array(*[_price() + top] * 4).alias("top"))
    left = side(items, _part() % 9, _price() + _quantity(), _price() + 3, _part() % 3)
    right = side(items.where(_part() % 11 != 0), (_part() + one(_supp() % 10 == 0)) % 9, _price() + _supp() % 5, _price() + _quantity() % 7, F.lit(0))
    return comparators.reconstruction_diff(left, right, ITEM, ["top"])


@unique_lines(f"WITH {_RECON} SELECT l_orderkey, l_linenumber, kind, out_delta, pred_delta, res_delta, top_delta FROM c ORDER BY abs(out_delta) DESC, l_orderkey, l_linenumber LIMIT 50", lineitem=TRACE)
def recon_largest(items):
    return comparators.largest(_recon(items), "out_delta", ITEM, 50).select(*ITEM, "kind", "out_delta", "pred_delta", "res_delta", "top_delta")


@unique_lines(f"""WITH {_RECON}, f AS (SELECT kind, arg_min(struct_pack(o := l_orderkey, l := l_linenumber, d := out_delta), l_orderkey * 100 + l_linenumber) FILTER (WHERE abs(out_delta) >= 40) AS x, count(*) AS n FROM c GROUP BY 1)
    SELECT kind, n::BIGINT AS n, x.o AS l_orderkey, x.l AS l_linenumber, x.d AS out_delta FROM f""", lineitem=TRACE)  # fmt: skip
def recon_earliest(items):
    return comparators.earliest_over(_recon(items), "kind", "out_delta", ITEM, 40)


@unique_lines(f"WITH {_RECON} SELECT ma, mb, count(*)::BIGINT AS n, sum(abs(out_delta))::BIGINT AS abs_out, sum(abs(pred_delta))::BIGINT AS abs_pred, sum(abs(res_delta))::BIGINT AS abs_res, sum(out_delta)::BIGINT AS signed_out, sum(res_delta)::BIGINT AS signed_res FROM c GROUP BY 1, 2", lineitem=TRACE)
def recon_summary(items):
    return comparators.mode_summary(_recon(items), ["a_mode", "b_mode"]).withColumnsRenamed({"a_mode": "ma", "b_mode": "mb"})


@unique_lines("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(v * 127::FLOAT) AS BIGINT)) AS x FROM embeddings),
    t AS (SELECT a.vec_id, b.vec_id - a.vec_id AS mv, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2]))) AS BIGINT) AS cost FROM q a JOIN q b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 4)
    SELECT vec_id, min(cost) AS cost, arg_min(mv, cost * 8 + mv)::BIGINT AS mv, count(*)::BIGINT AS n_tried FROM t GROUP BY 1""", embeddings=["vec_id", "embedding"])  # fmt: skip
def best_vector(vectors):
    x = vectors.select("vec_id", F.transform("embedding", component).alias("x"))
    moved = x.select(F.col("x").alias("y"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("mv"), F.col("vec_id").alias("at"))
    candidates = moved.select((F.col("at") - F.col("mv")).alias("vec_id"), "mv", "y")
    return comparators.best_vector(x, candidates, ["vec_id"], blocks.sad(F.col("x"), F.col("y")), ["mv"])


def _edges_sql() -> str:
    """Blocks as rows, each joined with the one before it across and down."""
    same = lambda r, x, y, s, u, v: f"(h.{r} = o.{s} AND (h.{r} < 0 OR (abs(h.{x} - o.{u}) < 4 AND abs(h.{y} - o.{v}) < 4)))"
    straight = f"{same('r0', 'x0', 'y0', 'r0', 'x0', 'y0')} AND {same('r1', 'x1', 'y1', 'r1', 'x1', 'y1')}"
    swapped = f"{same('r0', 'x0', 'y0', 'r1', 'x1', 'y1')} AND {same('r1', 'x1', 'y1', 'r0', 'x0', 'y0')}"
    moved = f"CASE WHEN h.is_b OR o.is_b THEN NOT ({straight}) AND NOT ({swapped}) ELSE NOT {same('r0', 'x0', 'y0', 'r0', 'x0', 'y0')} END"
    bs = f"""CASE WHEN edge = 0 THEN CASE WHEN h.intra OR coalesce(o.intra, FALSE) THEN 4 WHEN o.pic IS NULL THEN 0 WHEN h.nz OR o.nz THEN 2 WHEN {moved} THEN 1 ELSE 0 END
        WHEN h.t8 AND edge <> 2 THEN 0 WHEN h.intra THEN 3 WHEN h.nz OR o.nz THEN 2 WHEN {moved} THEN 1 ELSE 0 END"""
    return f"""WITH b AS (SELECT l_orderkey // 4 AS pic, l_linenumber * 4 + k % 4 AS bx, l_orderkey % 4 * 4 + k // 4 AS b_y, l_suppkey % 7 = 0 AS intra, l_orderkey // 4 % 2 = 0 AS is_b, l_partkey % 5 = 0 AS t8,
            (l_partkey + 3 * k) % 11 = 0 AS nz, (l_suppkey + k // 4) % 3 - 1 AS r0, (l_suppkey + k % 4) % 3 - 1 AS r1, l_partkey % 6 + k AS x0, l_partkey % 7 AS y0, l_partkey % 6 + k AS x1, l_suppkey % 9 - k AS y1
            FROM (SELECT *, unnest(range(16)) AS k FROM lineitem)),
        e AS (SELECT *, 'v' AS direction, bx % 4 AS edge, b_y % 4 AS line, bx - 1 AS ox, b_y AS oy FROM b UNION ALL SELECT *, 'h', b_y % 4, bx % 4, bx, b_y - 1 FROM b)
        SELECT h.pic, (h.bx // 4)::INT AS mb_x, h.b_y // 4 AS mb_y, direction, edge::INT AS edge, string_agg(CAST({bs} AS VARCHAR), '' ORDER BY line) AS bs
        FROM e h LEFT JOIN b o ON o.pic = h.pic AND o.bx = h.ox AND o.b_y = h.oy GROUP BY ALL"""


@unique_lines(_edges_sql(), lineitem=[*ITEM, "l_partkey", "l_suppkey"])
def edge_strengths(items):
    pic = F.floor(F.col("l_orderkey") / 4)
    each = lambda f: F.array(*[f(k) for k in range(16)])
    mbs = items.select(
        pic.alias("pic"), F.col("l_linenumber").alias("mb_x"), (F.col("l_orderkey") % 4).alias("mb_y"), (_supp() % 7 == 0).alias("intra"), (pic % 2 == 0).alias("is_b"), (_part() % 5 == 0).alias("transform_8x8"),
        each(lambda k: one((_part() + 3 * k) % 11 == 0)).alias("nz"), each(lambda k: (_supp() + k // 4) % 3 - 1).alias("ref0"), each(lambda k: (_supp() + k % 4) % 3 - 1).alias("ref1"),
        each(lambda k: _part() % 6 + k).alias("x0"), each(lambda k: _part() % 7).alias("y0"), each(lambda k: _part() % 6 + k).alias("x1"), each(lambda k: _supp() % 9 - k).alias("y1"),
    )
    return deblock.edge_strengths(mbs, ["pic"]).withColumn("bs", F.array_join(F.transform("bs", lambda b: b.cast("string")), ""))


_V = "list_transform(embedding[1:{n}], lambda v: CAST(floor(v * 127::FLOAT) AS BIGINT))"


def _ints(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select("vec_id", F.transform(F.slice("embedding", 1, n), component).alias("x"))


def _digest(values: Column) -> Column:
    """An array of numbers as text, so that results of many columns stay one."""
    return F.array_join(F.transform(values, lambda v: v.cast("long").cast("string")), ",").alias("y")


_EMBEDDING = {"embeddings": ["vec_id", "embedding"]}
_LEVELS8 = "[[20,18,32,19,25,24],[22,19,35,21,28,26],[26,23,42,24,33,31],[28,25,45,26,35,33],[32,28,51,30,40,38],[36,32,58,34,46,43]]"


@unique_lines(f"""WITH b AS (SELECT vec_id, vec_id % 52 AS qp, unnest({_V.format(n=64)}) AS x, unnest(range(64)) AS p FROM embeddings),
    c AS (SELECT *, p // 8 % 4 AS r, p % 4 AS k FROM b),
    w AS (SELECT *, x * {_LEVELS8}[qp % 6 + 1][CASE WHEN r % 4 = 0 AND k % 4 = 0 THEN 1 WHEN r % 2 = 1 AND k % 2 = 1 THEN 2 WHEN r = 2 AND k = 2 THEN 3 WHEN (r = 0 AND k % 2 = 1) OR (r % 2 = 1 AND k = 0) THEN 4 WHEN (r = 0 AND k = 2) OR (r = 2 AND k = 0) THEN 5 ELSE 6 END] * (1::BIGINT << (qp // 6)) AS v FROM c),
    z AS (SELECT vec_id, p, (CASE WHEN v < 0 THEN -(-v // 4) ELSE v // 4 END) AS v FROM w)
    SELECT vec_id, string_agg(CAST(((v + 32768) % 65536 + 65536) % 65536 - 32768 AS VARCHAR), ',' ORDER BY p) AS y FROM z GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def dequant_8x8(vectors):
    return _ints(vectors, 64).select("vec_id", _digest(blocks.dequant8x8(F.col("x"), F.col("vec_id") % 52, wrap=True)))


def _idct8_sql() -> str:
    """One pass over lines and one over columns, as columns v0 to v7."""

    def line(v: list[str]) -> list[str]:
        even = [f"({v[0]} + {v[4]})", f"({v[0]} - {v[4]})", f"(({v[2]} >> 1) - {v[6]})", f"({v[2]} + ({v[6]} >> 1))"]
        odd = [f"(-{v[3]} + {v[5]} - {v[7]} - ({v[7]} >> 1))", f"({v[1]} + {v[7]} - {v[3]} - ({v[3]} >> 1))", f"(-{v[1]} + {v[7]} + {v[5]} + ({v[5]} >> 1))", f"({v[3]} + {v[5]} + {v[1]} + ({v[1]} >> 1))"]
        b = [f"({even[0]} + {even[3]})", f"({even[1]} + {even[2]})", f"({even[1]} - {even[2]})", f"({even[0]} - {even[3]})"]
        c = [f"(({odd[3]} >> 2) + {odd[0]})", f"({odd[1]} + ({odd[2]} >> 2))", f"(({odd[1]} >> 2) - {odd[2]})", f"({odd[3]} - ({odd[0]} >> 2))"]
        return [f"{b[0]} + {c[3]}", f"{b[1]} + {c[2]}", f"{b[2]} + {c[1]}", f"{b[3]} + {c[0]}", f"{b[3]} - {c[0]}", f"{b[2]} - {c[1]}", f"{b[1]} - {c[2]}", f"{b[0]} - {c[3]}"]

    across = ", ".join(f"{e} AS h{k}" for k, e in enumerate(line([f"x[8 * r + {k + 1}]" for k in range(8)])))
    down = ", ".join(f"(({e}) + 32) >> 6 AS d{k}" for k, e in enumerate(line([f"l[{k + 1}]" for k in range(8)])))
    turned = " UNION ALL ".join(f"SELECT vec_id, r, {k} AS c, h{k} AS v FROM a" for k in range(8))
    back = " UNION ALL ".join(f"SELECT vec_id, {k} * 8 + c AS p, d{k} AS v FROM d" for k in range(8))
    return f"""WITH b AS (SELECT vec_id, {_V.format(n=64)} AS x, unnest(range(8)) AS r FROM embeddings), a AS (SELECT vec_id, r, {across} FROM b), t AS ({turned}),
        g AS (SELECT vec_id, c, list(v ORDER BY r) AS l FROM t GROUP BY 1, 2), d AS (SELECT vec_id, c, {down} FROM g), u AS ({back})
        SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY p) AS y FROM u GROUP BY 1"""


@unique_lines(_idct8_sql(), **_EMBEDDING)
def idct8x8(vectors):
    return _ints(vectors, 64).select("vec_id", _digest(blocks.idct8x8_column(F.col("x"))))


_SIGNS = "[[1,1,1,1],[1,1,-1,-1],[1,-1,-1,1],[1,-1,1,-1]]"


def _twice(matrix: str, n: int = 16) -> str:
    """M x block x M' as sums over rows, with qp along."""
    return f"""b AS (SELECT vec_id, vec_id % 52 AS qp, unnest({_V.format(n=n)}) AS x, unnest(range({n})) AS p FROM embeddings), o AS (SELECT unnest(range(4)) AS i), q AS (SELECT unnest(range(4)) AS j),
        s AS (SELECT vec_id, qp, i, j, CAST(sum(x * {matrix}[i + 1][p // 4 + 1] * {matrix}[j + 1][p % 4 + 1]) AS BIGINT) AS v FROM b, o, q GROUP BY ALL)"""


@unique_lines(f"WITH {_twice(_SIGNS)} SELECT vec_id, string_agg(CAST(CASE WHEN qp < 12 THEN (v * [10,11,13,14,16,18][qp % 6 + 1] + (1 << (1 - qp // 6))) >> (2 - qp // 6) ELSE (v * [10,11,13,14,16,18][qp % 6 + 1]) * (1 << (qp // 6 - 2)) END AS VARCHAR), ',' ORDER BY i, j) AS y FROM s GROUP BY 1", **_EMBEDDING)
def hadamard_dc(vectors):
    return _ints(vectors, 16).select("vec_id", _digest(blocks.luma_dc(F.col("x"), F.col("vec_id") % 52)))


@unique_lines(f"""WITH b AS (SELECT vec_id, vec_id % 52 AS qp, {_V.format(n=4)} AS x FROM embeddings),
    s AS (SELECT vec_id, qp, unnest([x[1] + x[2] + x[3] + x[4], x[1] - x[2] + x[3] - x[4], x[1] + x[2] - x[3] - x[4], x[1] - x[2] - x[3] + x[4]]) AS v, unnest(range(4)) AS i FROM b)
    SELECT vec_id, string_agg(CAST(CASE WHEN qp < 6 THEN (v * [10,11,13,14,16,18][qp % 6 + 1]) >> 1 ELSE v * [10,11,13,14,16,18][qp % 6 + 1] * (1 << (qp // 6 - 1)) END AS VARCHAR), ',' ORDER BY i) AS y FROM s GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def chroma_dc(vectors):
    return _ints(vectors, 4).select("vec_id", _digest(blocks.chroma_dc(F.col("x"), F.col("vec_id") % 52)))


@unique_lines(f"WITH {_twice('[[1,1,1,1],[2,1,-1,-2],[1,-1,-1,1],[1,-2,2,-1]]')} SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i, j) AS y FROM s GROUP BY 1", **_EMBEDDING)
def dct4x4(vectors):
    return _ints(vectors, 16).select("vec_id", _digest(blocks.dct4x4(F.col("x"))))


@unique_lines(f"""WITH b AS (SELECT vec_id, vec_id % 52 AS qp, unnest({_V.format(n=16)}) * 50 AS x, unnest(range(16)) AS p FROM embeddings),
    w AS (SELECT *, [[13107,5243,8066],[11916,4660,7490],[10082,4194,6554],[9362,3647,5825],[8192,3355,5243],[7282,2893,4559]][qp % 6 + 1][CASE WHEN p // 4 % 2 = 0 AND p % 2 = 0 THEN 1 WHEN p // 4 % 2 = 1 AND p % 2 = 1 THEN 2 ELSE 3 END] AS f FROM b)
    SELECT vec_id, string_agg(CAST(sign(x) * ((abs(x) * f + (1 << (15 + qp // 6)) // 3) >> (15 + qp // 6)) AS VARCHAR), ',' ORDER BY p) AS y FROM w GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def quant4x4(vectors):
    return _ints(vectors, 16).select("vec_id", _digest(blocks.quant4x4(F.transform("x", lambda v: v * 50), F.col("vec_id") % 52)))


def _dct8_pass(source: str, made: str, line: str) -> str:
    """One pass over rows (vec_id, r, c, v); ``line`` names the coordinate that stays."""
    moves = "c" if line == "r" else "r"
    wide = ", ".join(f"max(v) FILTER (WHERE {moves} = {i}) AS v{i}" for i in range(8))
    sums = ", ".join(f"v{i} + v{7 - i} AS a{i}, v{i} - v{7 - i} AS b{i}" for i in range(4))
    out = ["a0 + a1 + a2 + a3", "b0 + (b3 >> 1) + b1 + b2 + ((b0 + (b3 >> 1)) >> 2)", "a0 - a3 + ((a1 - a2) >> 1)", "b0 - (b3 >> 1) + b2 - b1 + ((b2 - b1) >> 2)", "a0 + a3 - a1 - a2", "b0 - (b3 >> 1) - b2 + b1 - ((b2 - b1) >> 2)", "((a0 - a3) >> 1) - a1 + a2", "b1 + b2 - b0 - (b3 >> 1) - ((b0 + (b3 >> 1)) >> 2)"]
    return f"{made} AS (SELECT vec_id, {line}, unnest(range(8)) AS {moves}, unnest([{', '.join(out)}]) AS v FROM (SELECT vec_id, {line}, {sums} FROM (SELECT vec_id, {line}, {wide} FROM {source} GROUP BY vec_id, {line})))"


@unique_lines(f"""WITH b AS (SELECT vec_id, p // 8 AS r, p % 8 AS c, v FROM (SELECT vec_id, unnest({_V.format(n=64)}) AS v, unnest(range(64)) AS p FROM embeddings)),
    {_dct8_pass("b", "across", "r")}, {_dct8_pass("across", "down", "c")}
    SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY r, c) AS y FROM down GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def dct8x8(vectors):
    return _ints(vectors, 64).select("vec_id", _digest(blocks.dct8x8(F.col("x"))))


@unique_lines(f"""WITH b AS (SELECT vec_id, {_V.format(n=64)} AS x, unnest(range(64)) AS p FROM embeddings)
    SELECT vec_id, string_agg(CAST(x[(p // 32 * 4 + p % 16 // 4) * 8 + p // 16 % 2 * 4 + p % 4 + 1] AS VARCHAR), ',' ORDER BY p) AS y, TRUE AS joins FROM b GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def split_8x8(vectors):
    parts = _ints(vectors, 64).withColumn("parts", syntax.split8x8(F.col("x")))
    return parts.select("vec_id", _digest(F.flatten("parts")), (syntax.join8x8(F.col("parts")) == F.col("x")).alias("joins"))


@unique_lines(f"""WITH b AS (SELECT vec_id, {_V.format(n=64)} AS x FROM embeddings), o AS (SELECT vec_id, x, unnest(range(4)) AS k FROM b)
    SELECT vec_id, string_agg(CAST(CASE WHEN (vec_id >> k) & 1 = 1 THEN (x[16 * k + 1] + 32) >> 6 ELSE 64 * (x[16 * k + 1]) END AS VARCHAR), ',' ORDER BY k) AS y FROM o GROUP BY 1""", **_EMBEDDING)  # fmt: skip
def masked_inverse(vectors):
    first = lambda k: F.get(F.col("x"), F.lit(16 * k))
    flat = F.array(*[F.array(first(k), *[F.lit(0).cast("long")] * 15) for k in range(4)])
    made = _ints(vectors, 64).select("vec_id", F.transform(blocks.inverse_where(flat, F.col("vec_id")), lambda b: F.get(b, F.lit(0))).alias("v"))
    return made.select("vec_id", _digest(F.transform("v", lambda v, k: F.when(F.call_function("shiftright", F.col("vec_id"), k).bitwiseAND(F.lit(1)) == 1, v).otherwise(64 * v))))


@unique_lines("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_suppkey % 2 = 0 THEN [47,31,15,0,23,27,29,30,7,11,13,14,39,43,45,46,16,3,5,10,12,19,21,26,28,35,37,42,44,1,2,4,8,17,18,20,24,6,9,22,25,32,33,34,36,40,38,41][l_partkey % 50 + 1]
    ELSE [0,16,1,2,4,8,32,3,5,10,12,15,47,7,11,13,14,6,9,31,35,37,42,44,33,34,36,40,39,43,45,46,17,18,20,24,19,21,26,28,23,27,29,30,22,25,38,41][l_partkey % 50 + 1] END, 0)::INT AS cbp FROM lineitem""", lineitem=[*ITEM, "l_partkey", "l_suppkey"])  # fmt: skip
def coded_block_pattern(items):
    return items.select(*ITEM, syntax.coded_block_pattern(_part() % 50, _supp() % 2 == 0).alias("cbp"))


_B_TYPES = "['L0L0L1L1', 'L0-', 'L1-', 'L0L1-', 'L0,L0', 'L0,L0', 'L1,L1', 'L1,L1', 'L0,L1', 'L0,L1', 'L1,L0', 'L1,L0', 'L0,L0L1', 'L0,L0L1', 'L1,L0L1', 'L1,L0L1', 'L0L1,L0', 'L0L1,L0', 'L0L1,L1', 'L0L1,L1', 'L0L1,L0L1', 'L0L1,L0L1']"


@unique_lines(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 24 AS t, l_suppkey % 13 AS s, CASE l_partkey % 24 WHEN 0 THEN 'L0L1,L0L1' WHEN 22 THEN 'L0L1,L0L1' WHEN 23 THEN ',' ELSE replace({_B_TYPES}[l_partkey % 24 + 1], '-', ',') END AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, contains(split_part(u, ',', 1), 'L0') AS l0_first, contains(split_part(u, ',', 2), 'L0') AS l0_second, contains(split_part(u, ',', 1), 'L1') AS l1_first, contains(split_part(u, ',', 2), 'L1') AS l1_second,
        s IN (1, 3, 4, 5, 8, 9, 10, 12) AS sub_l0, s IN (2, 3, 6, 7, 8, 9, 11, 12) AS sub_l1, (CASE WHEN s < 4 THEN 1 WHEN s < 10 THEN 2 ELSE 4 END)::INT AS sub_parts FROM t""", lineitem=[*ITEM, "l_partkey", "l_suppkey"])  # fmt: skip
def b_list_use(items):
    t, s = _part() % 24, _supp() % 13
    uses = [syntax.b_uses(t, which, part).alias(f"l{which}_{name}") for which in (0, 1) for part, name in ((0, "first"), (1, "second"))]
    return items.select(*ITEM, *uses, syntax.b_sub_uses(s, 0).alias("sub_l0"), syntax.b_sub_uses(s, 1).alias("sub_l1"), syntax.b_sub_parts(s).alias("sub_parts"))


@unique_lines(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 23 AS t, [(l_suppkey + k * l_linenumber) % 13 FOR k IN range(4)] AS subs FROM lineitem),
    q AS (SELECT l_orderkey, l_linenumber, bit_or(CASE WHEN s = 0 THEN 61696 ELSE (CASE WHEN s IN (1, 3, 4, 5, 8, 9, 10, 12) THEN 4096 << (k % 2) ELSE 0 END) + (CASE WHEN s IN (2, 3, 6, 7, 8, 9, 11, 12) THEN 16384 << (k % 2) ELSE 0 END) END) AS f FROM (SELECT l_orderkey, l_linenumber, unnest(subs) AS s, unnest(range(4)) AS k FROM t) GROUP BY 1, 2)
    SELECT l_orderkey, l_linenumber, (CASE WHEN t = 22 THEN 64 | f ELSE [61704, 4104, 16392, 20488, 12304, 12320, 49168, 49184, 36880, 36896, 24592, 24608, 45072, 45088, 57360, 57376, 28688, 28704, 53264, 53280, 61456, 61472][t + 1] END)::BIGINT AS flags FROM t JOIN q USING (l_orderkey, l_linenumber)""",
    lineitem=[*ITEM, "l_partkey", "l_suppkey"])
def b_type_flags(items):
    subs = F.array(*[(_supp() + k * F.col("l_linenumber")) % 13 for k in range(4)])
    return items.select(*ITEM, syntax.b_type_flags(_part() % 23, subs).cast("long").alias("flags"))


@unique_lines("SELECT l_orderkey, l_linenumber, (CASE l_partkey % 8 WHEN 0 THEN 12296 WHEN 1 THEN 12304 WHEN 2 THEN 12320 WHEN 3 THEN 12352 WHEN 4 THEN 12352 ELSE 1 END)::BIGINT AS flags FROM lineitem", lineitem=[*ITEM, "l_partkey"])
def p_type_flags(items):
    return items.select(*ITEM, syntax.p_type_flags(_part() % 8).cast("long").alias("flags"))


@unique_lines("""WITH s AS (SELECT l_orderkey, l_linenumber, (l_partkey % 120) * (l_suppkey % 70) AS size, l_partkey % 50 AS rate FROM lineitem), v AS (SELECT *, CASE WHEN rate = 0 OR size = 0 THEN 1 ELSE size // rate + 1 END AS v FROM s)
    SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM range(40) r(k) WHERE (1::BIGINT << k) <= v - 1)::BIGINT AS bits FROM v""", lineitem=[*ITEM, "l_partkey", "l_suppkey"])  # fmt: skip
def slice_group_bits(items):
    return items.select(*ITEM, scalar.slice_group_bits(_part() % 120, _supp() % 70, _part() % 50).cast("long").alias("bits"))


@unique_lines("""WITH t AS (SELECT *, l_suppkey % 3 AS kind, [(l_partkey + k) // 3 % 5 FOR k IN range(4)] AS subs, l_linenumber % 2 = 0 AS inference FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey % 5 <> 0 AND l_partkey % 48 & 15 <> 0 AND CASE WHEN kind = 0 THEN len(list_filter(subs, lambda s: s <> 0)) = 0 WHEN kind = 1 THEN len(list_filter(subs, lambda s: s >= 4 OR (s = 0 AND NOT inference))) = 0 ELSE inference END AS present FROM t""", lineitem=[*ITEM, "l_partkey", "l_suppkey"])  # fmt: skip
def transform_flag(items):
    subs = F.array(*[F.floor((_part() + k) / 3) % 5 for k in range(4)])
    kind = _supp() % 3
    b_type = F.when(kind == 1, 22).when(kind == 2, 0)
    return items.select(*ITEM, syntax.transform8x8_flag_present(_part() % 5 != 0, _part() % 48, kind == 0, b_type, subs, F.col("l_linenumber") % 2 == 0).alias("present"))


@unique_lines(f"SELECT vec_id, string_agg(CAST(x[p + 1] AS VARCHAR), ',' ORDER BY [0,1,4,5,2,3,6,7,8,9,12,13,10,11,14,15][p + 1]) AS y FROM (SELECT vec_id, {_V.format(n=16)} AS x, unnest(range(16)) AS p FROM embeddings) GROUP BY 1", **_EMBEDDING)
def coding_order(vectors):
    return _ints(vectors, 16).select("vec_id", _digest(syntax.coding_to_raster(F.col("x"))))


EVENT = ["user_id", "event_id"]


@unique_lines("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20", events=EVENT)
def limit_decoded(events):
    return sequence.limit_decoded(events, "user_id", "event_id", 20)


@unique_lines("SELECT user_id, count(*)::BIGINT AS n_pictures, count(*) FILTER (WHERE event_type = 'signup')::BIGINT AS n_idr, max(event_id % 640) AS width, max(event_id % 360) AS height FROM events GROUP BY 1", events=[*EVENT, "event_type"])
def stream_summary(events):
    rows = events.withColumn("w", F.col("event_id") % 640).withColumn("h", F.col("event_id") % 360)
    return sequence.stream_summary(rows, "user_id", "w", "h", F.col("event_type") == "signup")


@unique_lines("SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN 1 ELSE event_id % 3 END AS k FROM events", events=EVENT)
def order_key(events):
    return events.select(*EVENT, scalar.order_key(F.col("event_id") % 3, F.col("event_id") % 2).alias("k"))
