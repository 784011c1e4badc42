"""Queries over pictures and planes: memory operations, list edits, paired planes; each with SQL written from the rule, not from the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.operators import compensate, planes, references
from lumaframe.plans.register import Register

registered = Register()

EVENT = ["user_id", "event_id"]

#: Pictures of the events: a stream for each user, IDR at signups, no reference at errors, frame numbers of three bits that wrap and repeat.
_EVENT_PICTURES = """
    e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_type = 'signup' AS idr, event_type <> 'error' AS ref,
                 CAST(floor(abs(value)) AS BIGINT) % 8 AS n, CAST(floor(value / 3) AS BIGINT) AS p, ((CAST(floor(value / 3) AS BIGINT) % 4) + 4) % 4 AS lsb FROM events),
    held AS (SELECT user_id, rn, [] :: STRUCT(i BIGINT, n BIGINT, p BIGINT, lsb BIGINT)[] AS refs, CASE WHEN ref THEN [{'i': event_id, 'n': n, 'p': p, 'lsb': lsb}] ELSE [] END AS after FROM e WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, refs, CASE WHEN NOT ref THEN refs WHEN len(kept) >= 4 THEN list_append(kept[len(kept) - 2:], cur) ELSE list_append(kept, cur) END
        FROM (SELECT *, CASE WHEN event_id % 23 = 0 THEN [] ELSE list_filter(one, lambda x: coalesce(x.i <> list_min(list_transform(list_filter(one, lambda y: y.n = t2 AND y.p = list_max(list_transform(list_filter(one, lambda z: z.n = t2), lambda z: z.p))), lambda y: y.i)), true)) END AS kept
            FROM (SELECT *, list_filter(refs, lambda x: coalesce(x.i <> list_min(list_transform(list_filter(refs, lambda y: y.n = t1 AND y.p = list_max(list_transform(list_filter(refs, lambda z: z.n = t1), lambda z: z.p))), lambda y: y.i)), true)) AS one
                FROM (SELECT e.user_id, e.rn, e.event_id, e.ref, {'i': e.event_id, 'n': e.n, 'p': e.p, 'lsb': e.lsb} AS cur, CASE WHEN e.idr THEN [] ELSE h.after END AS refs,
                             CASE WHEN e.event_id % 3 = 0 THEN (e.n - e.event_id % 8 - 1 + 8) % 8 END AS t1, CASE WHEN e.event_id % 2 = 0 THEN (e.n - (e.event_id // 8) % 8 - 1 + 8) % 8 END AS t2
                      FROM e JOIN held h ON h.user_id = e.user_id AND e.rn = h.rn + 1)))),
    pictures AS (SELECT e.*, h.refs FROM e JOIN held h USING (user_id, rn))"""


def _held(events: DataFrame) -> DataFrame:
    at = F.col("event_id")
    frame_num, poc = F.floor(F.abs("value")) % 8, F.floor(F.col("value") / 3)
    op = lambda when, code, a: F.when(when, F.struct(F.lit(code).alias("op"), a.cast("long").alias("a")))
    ops = F.filter(F.array(op(at % 3 == 0, 1, at % 8), op(at % 2 == 0, 1, F.floor(at / 8) % 8), op(at % 23 == 0, 5, F.lit(0)), op(at % 4 == 0, 2, at)), lambda o: o.isNotNull())
    pictures = events.select(*EVENT, frame_num.alias("n"), poc.alias("p"), F.pmod(poc, F.lit(4)).alias("low"), (F.col("event_type") == "signup").alias("idr"), (F.col("event_type") != "error").alias("is_ref"), ops.alias("ops"))
    return references.hold_references(pictures, "user_id", "event_id", F.col("idr"), F.col("is_ref"), F.col("n"), F.col("p"), F.col("ops"), 8, 4, F.col("low"))


def _names(refs):
    return F.array_join(F.transform(refs, lambda r: r["ref"].cast("string")), ",")


@registered.query(f"WITH RECURSIVE {_EVENT_PICTURES} SELECT user_id, event_id, len(refs)::BIGINT AS n_refs, array_to_string(list_transform(refs, lambda x: x.i), ',') AS refs FROM pictures", events=[*EVENT, "event_type", "value"])
def dpb_memory_ops(events):
    return _held(events).select(*EVENT, F.size("refs").cast("long").alias("n_refs"), _names(F.col("refs")).alias("refs"))


def _edit_sql(b_slice: bool) -> str:
    """Three edits one behind the other, each a query over the one before; an event has its number modulo 4 of them."""
    out, last = [], "listed_b" if b_slice else "listed_p"
    for k in range(3):
        name = f"{'b' if b_slice else 'p'}{k}"
        op, value = f"(event_id // {k + 1}) % 3", f"(event_id // {k + 2}) % 9"
        on = f"event_id % 4 > {k} AND {op} < 2" + (f" AND len(l) > {k}" if b_slice else "")
        found = "coalesce(list_position(list_transform(l, lambda x: x.n), num), 0)"
        shifted = f"l[:{k}] || [l[fnd]] || list_filter(l, lambda x, j: j > {k} AND j <> fnd)"
        if b_slice:
            new = f"CASE WHEN NOT acts OR fnd <= {k} THEN l ELSE {shifted} END"
        else:
            new = f"CASE WHEN NOT acts OR fnd = 0 THEN l WHEN len(l) <= {k} THEN list_append(l, l[fnd]) WHEN fnd <= {k} THEN l[:{k}] || [l[fnd]] || l[{k + 1}:] ELSE {shifted} END"
        out.append(f"""{name} AS (SELECT user_id, event_id, num, {new} AS l FROM (SELECT *, {found} AS fnd FROM (
            SELECT user_id, event_id, l, {on} AS acts, CASE WHEN {on} THEN ((num + CASE WHEN {op} = 0 THEN -1 ELSE 1 END * ({value} + 1)) % 8 + 8) % 8 ELSE num END AS num FROM {last})))""")
        last = name
    return ", ".join(out)


@registered.query(f"""
    WITH RECURSIVE {_EVENT_PICTURES},
    listed_p AS (SELECT user_id, event_id, n AS num, CASE WHEN len(list_distinct(list_transform(refs, lambda x: x.n))) < 2 THEN list_reverse(refs)
        ELSE list_transform(list_sort(list_transform(refs, lambda x: [-x.n, -x.lsb, -x.i])), lambda k: list_filter(refs, lambda x: x.i = -k[3])[1]) END AS l FROM pictures),
    listed_b AS (SELECT user_id, event_id, n AS num, list_transform(list_sort(list_transform(list_filter(refs, lambda x: x.p < p), lambda x: [-x.p, x.i])), lambda k: list_filter(refs, lambda x: x.i = k[2])[1]) AS l FROM pictures),
    one AS (SELECT user_id, event_id, list_transform(list_sort(list_transform(list_filter(refs, lambda x: x.p > p), lambda x: [x.p, -x.n, x.i])), lambda k: k[3]) || list_transform(list_sort(list_transform(list_filter(refs, lambda x: x.p <= p), lambda x: [-x.p, -x.n, x.i])), lambda k: k[3]) AS l FROM pictures),
    {_edit_sql(False)}, {_edit_sql(True)}
    SELECT user_id, event_id, array_to_string(list_transform(p2.l, lambda x: x.i), ',') AS list_p, array_to_string(list_transform(b2.l, lambda x: x.i), ',') AS list_b0, array_to_string(one.l, ',') AS list_b1
    FROM p2 JOIN b2 USING (user_id, event_id) JOIN one USING (user_id, event_id)""", events=[*EVENT, "event_type", "value"])  # fmt: skip
def ref_list_edits(events):
    at = F.col("event_id")
    edits = F.slice(F.array(*[F.struct((F.floor(at / (k + 1)) % 3).alias("op"), (F.floor(at / (k + 2)) % 9).alias("value")) for k in range(3)]), 1, (at % 4).cast("int"))
    held = _held(events).withColumn("edits", edits)
    zero, one = references.first_lists_b(F.col("refs"), F.col("p"))
    edit = lambda first, b: _names(references.edit_list(first, F.col("edits"), F.col("n"), 8, b))
    return held.select(*EVENT, edit(references.first_list_p(F.col("refs")), False).alias("list_p"), edit(zero, True).alias("list_b0"), _names(one).alias("list_b1"))


_BYTES = """
    d AS (SELECT doc_id, lang, regexp_extract_all(hex(encode(text)), '..') AS a, regexp_extract_all(hex(encode(translate(text, 'eo', 'fa') || CASE WHEN doc_id % 7 = 0 THEN '!' ELSE '' END)), '..') AS b FROM documents),
    s AS (SELECT doc_id, lang, k, ('0x' || x)::INTEGER AS x, ('0x' || y)::INTEGER AS y FROM (SELECT doc_id, lang, unnest(range(least(len(a), len(b)))) AS k, unnest(a[:least(len(a), len(b))]) AS x, unnest(b[:least(len(a), len(b))]) AS y FROM d)),
    f AS (SELECT doc_id, min(k) AS k FROM s WHERE x <> y GROUP BY 1)"""


def _text_planes(docs: DataFrame) -> DataFrame:
    """A document's bytes as a plane, beside a changed and sometimes longer copy that comes from another table."""
    key = ["doc_id", "lang", "plane"]
    one = docs.where("text IS NOT NULL").select("doc_id", "lang", F.lit("Y").alias("plane"), F.lit(16).alias("width"), F.lit(16).alias("height"), "text")
    changed = F.concat(F.translate("text", "eo", "fa"), F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))
    side = lambda text: one.select(*key, "width", "height", text.cast("binary").alias("data"))
    return planes.plane_partials(planes.pair_planes(side(F.col("text")), side(changed), key), key)


@registered.query(f"""
    WITH {_BYTES}
    SELECT doc_id, count(*)::BIGINT AS samples, sum((x - y) * (x - y))::BIGINT AS sse, count(*) FILTER (WHERE x <> y)::BIGINT AS differing, max(abs(x - y))::BIGINT AS max_diff, sum(x)::BIGINT AS sum_a, sum(y)::BIGINT AS sum_b,
           max(f.k)::BIGINT AS first_at, max(x) FILTER (WHERE s.k = f.k)::BIGINT AS first_a, max(y) FILTER (WHERE s.k = f.k)::BIGINT AS first_b, max(doc_id) % 7 <> 0 AS same_size
    FROM s LEFT JOIN f USING (doc_id) GROUP BY doc_id""", documents=["doc_id", "lang", "text"])  # fmt: skip
def plane_partials(docs):
    return _text_planes(docs).where("samples > 0").drop("lang", "plane")


@registered.query(f"""
    WITH {_BYTES}
    SELECT lang, count(*)::BIGINT AS samples, sum((x - y) * (x - y))::DOUBLE AS sse, count(*) FILTER (WHERE x <> y)::BIGINT AS differing, max(abs(x - y))::DOUBLE AS max_diff, sum(x)::DOUBLE / count(*) AS mean_a, sum(y)::DOUBLE / count(*) AS mean_b,
           CASE WHEN count(*) FILTER (WHERE x <> y) = 0 THEN 'Infinity'::DOUBLE ELSE 10 * log10(65025.0::DOUBLE * count(*) / sum((x - y) * (x - y))) END AS psnr, bool_and(doc_id % 7 <> 0) AS same_size,
           min(CASE WHEN x <> y THEN doc_id END) AS first_doc, (SELECT k FROM f WHERE f.doc_id = min(CASE WHEN x <> y THEN s.doc_id END))::BIGINT AS first_at
    FROM s GROUP BY lang""", documents=["doc_id", "lang", "text"])  # fmt: skip
def plane_totals(docs):
    return planes.merge_partials(_text_planes(docs).where("samples > 0"), ["lang"], ["doc_id"]).select("*", F.col("first.doc_id").alias("first_doc"), F.col("first.first_at").alias("first_at")).drop("first")


def _sample(dx: int, dy: int) -> str:
    return f"x[8 * greatest(least(iy + {dy}, 7), 0) + greatest(least(ix + {dx}, 7), 0) + 1]"


def _filtered(places: list[tuple[int, int]]) -> str:
    return "(" + " + ".join(f"{weight} * {_sample(*place)}" for weight, place in zip([1, -5, 20, 20, -5, 1], places, strict=True)) + ")"


def _compensated() -> str:
    """Every predicted sample by the standard's names: b, h, j, s and m between the whole samples, quarters as means of two."""
    clip = lambda v, half, bits: f"greatest(least(({v} + {half}) >> {bits}, 255), 0)"
    across = lambda dy: _filtered([(i, dy) for i in range(-2, 4)])
    down = lambda dx: _filtered([(dx, i) for i in range(-2, 4)])
    middle = " + ".join(f"{weight} * {across(i - 2)}" for i, weight in enumerate([1, -5, 20, 20, -5, 1]))
    means = {(1, 0): "wb", (3, 0): "rb", (0, 1): "wh", (0, 3): "uh", (1, 1): "bh", (2, 1): "bj", (3, 1): "bm", (1, 2): "hj", (3, 2): "jm", (1, 3): "hs", (2, 3): "js", (3, 3): "sm"}
    cases = " ".join(f"WHEN fx = {x} AND fy = {y} THEN ({a} + {b} + 1) >> 1" for (x, y), (a, b) in means.items())
    luma = f"CASE WHEN w IS NULL THEN NULL WHEN fx = 0 AND fy = 0 THEN w WHEN fx = 2 AND fy = 0 THEN b WHEN fx = 0 AND fy = 2 THEN h WHEN fx = 2 AND fy = 2 THEN j {cases} END"
    return f"""
    WITH p AS (SELECT vec_id - 1 AS vec_id, list_transform(embedding[1:64], lambda v: CAST(abs(floor(v * 127::FLOAT)) AS INTEGER) % 256) AS x FROM embeddings),
    v AS (SELECT vec_id, (vec_id * 7) % 61 - 30 AS mvx, (vec_id * 5) % 53 - 26 AS mvy, unnest(range(16)) AS k FROM embeddings),
    y AS (SELECT vec_id, k, x, vec_id % 2 * 4 + k % 4 + CAST(floor(mvx / 4) AS INTEGER) AS ix, vec_id // 2 % 2 * 4 + k // 4 + CAST(floor(mvy / 4) AS INTEGER) AS iy, mvx - 4 * CAST(floor(mvx / 4) AS INTEGER) AS fx, mvy - 4 * CAST(floor(mvy / 4) AS INTEGER) AS fy FROM v LEFT JOIN p USING (vec_id)),
    u AS (SELECT vec_id, k, x, vec_id % 2 * 4 + k % 4 + CAST(floor(mvx / 8) AS INTEGER) AS ix, vec_id // 2 % 2 * 4 + k // 4 + CAST(floor(mvy / 8) AS INTEGER) AS iy, mvx - 8 * CAST(floor(mvx / 8) AS INTEGER) AS fx, mvy - 8 * CAST(floor(mvy / 8) AS INTEGER) AS fy FROM v LEFT JOIN p USING (vec_id)),
    f AS (SELECT vec_id, k, fx, fy, {_sample(0, 0)} AS w, {_sample(1, 0)} AS r, {_sample(0, 1)} AS u, {clip(across(0), 16, 5)} AS b, {clip(across(1), 16, 5)} AS s, {clip(down(0), 16, 5)} AS h, {clip(down(1), 16, 5)} AS m, {clip(f"({middle})", 512, 10)} AS j FROM y),
    every AS (SELECT vec_id, 'Y' AS plane, k, {luma} AS v FROM f
        UNION ALL SELECT vec_id, 'U', k, ((8 - fx) * (8 - fy) * {_sample(0, 0)} + fx * (8 - fy) * {_sample(1, 0)} + (8 - fx) * fy * {_sample(0, 1)} + fx * fy * {_sample(1, 1)} + 32) >> 6 FROM u)
    SELECT vec_id, plane, string_agg(printf('%02X', v), '' ORDER BY k) AS predicted FROM every GROUP BY 1, 2"""


@registered.query(_compensated(), embeddings=["vec_id", "embedding"])
def motion_compensation(vectors):
    at = F.col("vec_id")
    both = F.explode(F.array(F.lit("Y"), F.lit("U"))).alias("plane")
    size = [F.lit(8).alias("width"), F.lit(8).alias("height")]
    samples = F.transform(F.slice("embedding", 1, 64), lambda v: F.lpad(F.hex(F.abs(F.floor(v * 127)) % 256), 2, "0"))
    held = vectors.select((at - 1).alias("vec_id"), both, *size, F.unhex(F.array_join(samples, "")).alias("data"))
    place = {"x": at % 2 * 4, "y": F.floor(at / 2) % 2 * 4, "w": F.lit(4), "h": F.lit(4), "mvx": at * 7 % 61 - 30, "mvy": at * 5 % 53 - 26}
    blocks = vectors.select("vec_id", both, *[v.cast("int").alias(n) for n, v in place.items()], *size)
    return compensate.compensate(blocks, held, ["vec_id"]).select("vec_id", "plane", F.hex("predicted").alias("predicted"))
