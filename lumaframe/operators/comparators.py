"""Comparators of two macroblock traces: what differs, what is missing and what is left out of the comparison.

A trace is a table with key columns and typed fields. Sides are joined on the
keys; a comparator says which fields differ by conditions over the columns
``a_...`` of the left side and ``b_...`` of the right one. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.functions import syntax
from lumaframe.operators.compare import classify_delta
from lumaframe.operators.sequence import repeat_number


def _sided(rows: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keys])


def field_diff(left: DataFrame, right: DataFrame, keys: list[str], differs: dict[str, Column], how: str = "left") -> DataFrame:
    """The joined sides with status (equal, differs, missing) and fields, the names of the conditions that hold.

    ``how``: left, so that rows of the left side alone are missing, or inner.
    A condition that is null does not hold. Keys should be unique on each side.
    Both sides grow with the traces and may hold arrays, whose sizes Spark
    underestimates, so it is a merge join at every size.
    """
    both = _sided(left, keys, "a").join(_sided(right, keys, "b").withColumn("_found", F.lit(True)).hint("merge"), keys, how)
    fields = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in differs.items()]))
    both = both.withColumn("fields", F.when(F.col("_found"), F.array_join(fields, ",")).otherwise(""))
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("fields") != "", "differs").otherwise("equal")
    return both.withColumn("status", status).drop("_found")


def _not_same(name: str) -> Column:
    return ~F.col(f"a_{name}").eqNullSafe(F.col(f"b_{name}"))


def state_diff(left: DataFrame, right: DataFrame, keys: list[str], *, with_low: bool = False) -> DataFrame:
    """Arithmetic decoder states (kind, range and, if asked, low) by macroblock."""
    names = ["kind", "range", *(["low"] if with_low else [])]
    return field_diff(left, right, keys, {n: _not_same(n) for n in names})


def representative_block(rows: DataFrame, keys: list[str], line: str, w: str, h: str, vector: list[str]) -> DataFrame:
    """keys, w, h and vector of each key's largest block (the first among equals), area_sum, all vectors, and ambiguous.

    An ordered fold: a key is ambiguous if a block of the area that led then
    had another vector or shape, whatever follows.
    """
    block = F.struct(F.col(line).alias("line"), (F.col(w) * F.col(h)).cast("long").alias("area"), F.col(w).cast("long").alias("w"), F.col(h).cast("long").alias("h"), F.array(*[F.col(v).cast("long") for v in vector]).alias("v"))
    start = F.struct(F.lit(-1).cast("long").alias("area"), *[F.lit(None).cast("long").alias(c) for c in ("w", "h")], F.lit(None).cast("array<long>").alias("v"), F.lit(False).alias("ambiguous"))

    def step(acc: Column, x: Column) -> Column:
        larger, tied = x["area"] > acc["area"], (x["area"] == acc["area"]) & ((x["v"] != acc["v"]) | (x["w"] != acc["w"]) | (x["h"] != acc["h"]))
        return F.struct(*[F.when(larger, x[c]).otherwise(acc[c]).alias(c) for c in ("area", "w", "h", "v")], (acc["ambiguous"] | tied).alias("ambiguous"))

    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(block)).alias("_blocks"))
    found = listed.select(*keys, F.aggregate("_blocks", start, step).alias("r"), F.aggregate("_blocks", F.lit(0).cast("long"), lambda s, x: s + x["area"]).alias("area_sum"), F.transform("_blocks", lambda x: x["v"]).alias("candidates"))
    return found.select(*keys, "r.w", "r.h", *[F.get("r.v", F.lit(i)).alias(v) for i, v in enumerate(vector)], "r.ambiguous", "area_sum", "candidates")


def vector_diff(ours: DataFrame, blocks: DataFrame, keys: list[str], line: str, kind: str, *, skip_kinds: tuple = (), only_unambiguous: bool = True, full_block: bool = False, full_cover: bool = False, match_any: bool = False) -> DataFrame:
    """keys and outcome of each macroblock on both sides: match, mismatch, skipped_ambiguous, skipped_size or skipped_coverage.

    ours: keys, ``kind``, mvx and mvy; blocks: keys, ``line``, w, h, mvx and
    mvy, several a key. Rows of ``skip_kinds`` and keys of one side only take
    no part. ``full_block``: only 16x16 blocks; ``full_cover``: only keys whose
    blocks make up 256 samples; ``match_any``: any block's vector will do.
    """
    theirs = representative_block(blocks, keys, line, "w", "h", ["mvx", "mvy"])
    both = _sided(ours.where(~F.col(kind).isin(*skip_kinds)) if skip_kinds else ours, keys, "a").join(_sided(theirs, keys, "b"), keys)
    same = (F.col("a_mvx") == F.col("b_mvx")) & (F.col("a_mvy") == F.col("b_mvy"))
    if match_any:
        same = same | F.array_contains("b_candidates", F.array(F.col("a_mvx").cast("long"), F.col("a_mvy").cast("long")))
    rules = [(only_unambiguous, F.col("b_ambiguous"), "skipped_ambiguous"), (full_block, (F.col("b_w") != 16) | (F.col("b_h") != 16), "skipped_size"), (full_cover, F.col("b_area_sum") != 256, "skipped_coverage")]
    outcome = F.when(F.lit(False), "")
    for asked, left_out, name in rules:
        outcome = outcome.when(left_out, name) if asked else outcome
    return both.select(*keys, outcome.when(same, "match").otherwise("mismatch").alias("outcome"), F.size("b_candidates").cast("long").alias("n_candidates"))


def outcome_counts(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``): mismatches, compared and the rows skipped for each reason."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return compared.groupBy(*(by or [])).agg(n("mismatch").alias("mismatches"), n("match", "mismatch").alias("compared"), *[n(f"skipped_{r}").alias(f"skipped_{r}") for r in ("ambiguous", "size", "coverage")])


def _direct(flags: str, known: list[int]) -> Column:
    return F.transform(flags, lambda s: s.isin(*known))


def direct_diff(left: DataFrame, right: DataFrame, keys: list[str], *, with_sub: bool = False, with_top: bool = True) -> DataFrame:
    """Direct-mode rows (spatial, ref_mv, sub flags and submv by quarter) by macroblock.

    Negative spatial flags are unknown. Sub-vectors count only in quarters that
    are direct on both sides, sub flags only in the others.
    """
    known = syntax.DIRECT_FLAGS
    quarters = F.arrays_zip("a_sub", "b_sub", "a_submv", "b_submv")
    both = lambda q: q["a_sub"].isin(*known) & q["b_sub"].isin(*known)
    differs = {"spatial": (F.col("a_spatial") >= 0) & (F.col("b_spatial") >= 0) & _not_same("spatial")}
    if with_top:
        differs["ref_mv"] = _not_same("ref_mv")
    if with_sub:
        differs["sub"] = F.exists(quarters, lambda q: ~both(q) & (q["a_sub"] != q["b_sub"]))
    differs["submv"] = F.exists(quarters, lambda q: both(q) & (q["a_submv"] != q["b_submv"]))
    return field_diff(left, right, keys, differs)


def bidi_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Resolved motion of B macroblocks: mbtype, sub flags and, each as (ref0, ref1, x0, y0, x1, y1), ref_mv and p1; submv by quarter.

    The left side's mbtype is a flag set, the right side's the syntax number.
    Left rows of intra macroblocks take no part. A list counts only where it is
    used; list-use that differs is a difference unless the vectors agree; rows
    that are all direct may show other representatives as long as all else agrees.
    """
    plain = lambda side: F.transform(f"{side}_sub", lambda s: F.when(s.isin(*syntax.DIRECT_CELLS), F.lit(syntax.DIRECT_CELLS[0])).otherwise(s))
    all_direct = F.forall("a_sub", lambda s: s.isin(*syntax.DIRECT_CELLS)) & F.forall("b_sub", lambda s: s.isin(*syntax.DIRECT_CELLS))
    uses = lambda side, which, part: (syntax.flags_use if side == "a" else syntax.number_uses)(F.col(f"{side}_mbtype"), F.col(f"{side}_sub"), which, part)

    def motion(name: str, other: str, part: int) -> Column:
        parts = []
        for which in (0, 1):
            pick = lambda side: F.struct(*[F.get(f"{side}_{name}", F.lit(i)) for i in (which, 2 + 2 * which, 3 + 2 * which)])  # noqa: B023, E731
            unset = (F.get(f"a_{name}", F.lit(which)) < 0) & (F.get(f"b_{name}", F.lit(which)) < 0)
            ours, theirs = uses("a", which, part), uses("b", which, part)
            parts.append((pick("a") != pick("b")) & ((ours != theirs) | (ours & ~unset)))
        exempt = all_direct & (plain("a") == plain("b")) & ~_not_same(other) & ~_not_same("submv")
        return ~exempt & (parts[0] | parts[1])

    shaped = F.exists("a_sub", lambda s: s.bitwiseAND(64) != 0) | (F.col("b_mbtype") == 22)
    shown = _not_same("ref_mv") | _not_same("p1") | _not_same("submv")
    quarters = [
        F.get("a_sub", F.lit(i)).isin(*syntax.DIRECT_CELLS) & F.get("b_sub", F.lit(i)).isin(*syntax.DIRECT_CELLS) & uses("a", 0, i) & uses("b", 0, i) & (F.get("a_submv", F.lit(i)) != F.get("b_submv", F.lit(i)))
        for i in range(4)
    ]
    differs = {"ref_mv": motion("ref_mv", "p1", 0), "p1": motion("p1", "ref_mv", 1), "sub": shaped & (plain("a") != plain("b")) & shown, "submv": quarters[0] | quarters[1] | quarters[2] | quarters[3]}
    return field_diff(left.where(F.col("mbtype").bitwiseAND(7) == 0), right, keys, differs)


def partition_vectors(wide: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Columns ``<field><list>`` (first partition) and ``<field><list>p1`` (second) as rows of keys, part and list."""
    rows = [F.struct(F.lit(part).alias("part"), F.lit(which).alias("list"), *[F.col(f"{f}{which}{suffix}").alias(f) for f in fields]) for part, suffix in ((0, ""), (1, "p1")) for which in (0, 1)]
    return wide.select(*keys, F.inline(F.array(*rows)))


def partition_diff(left: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Vector differences, predictors and vectors (mvd, mvp, final) of B partitions against a wide trace."""
    return field_diff(left, partition_vectors(wide, keys, ["mvd", "mvp", "final"]), [*keys, "part", "list"], {n: _not_same(n) for n in ("mvd", "mvp", "final")})


def raw_partition_diff(left: DataFrame, right: DataFrame, keys: list[str], line: str, *, occurrences: tuple[int, int] = (0, 0), pocs: tuple[int | None, int | None] = (None, None), with_low: bool = False) -> DataFrame:
    """Vector differences of B partitions with the decoder's state before and after them (amvd, mvd, pre_range, post_range and, if asked, both lows).

    A macroblock may be traced several times: of each side's rows of a key, in
    the order of ``line``, the one that was seen ``occurrences`` times before
    is compared. ``pocs`` keeps the rows of one picture order of a side first;
    rows without one go then.
    """

    def chosen(rows: DataFrame, poc: int | None, seen: int) -> DataFrame:
        rows = rows if poc is None else rows.where(F.col("poc") == poc)
        return repeat_number(rows, keys, line).where(F.col("repeat") == seen)

    names = ["amvd", "pre_low", "pre_range", "mvd", "post_range", "post_low"]
    sides = [chosen(*args).select(*keys, *names) for args in zip((left, right), pocs, occurrences, strict=True)]
    return field_diff(*sides, keys, {n: _not_same(n) for n in names if with_low or not n.endswith("low")})


def _small(v: Column) -> Column:
    return (F.abs(F.get(v, F.lit(1))) <= 1) & (F.abs(F.get(v, F.lit(2))) <= 1)


def colocated_zero_diff(left: DataFrame, right: DataFrame, keys: list[str], occurrence: str, *, any_occurrence: bool = False, only_small: bool = False) -> DataFrame:
    """Colocated motion (ref_mv as ref, x, y) and whether it counts as zero.

    fields is zero where the decision differs, else motion where the motion
    does. ``any_occurrence``: of a key's rows on the right, one of equal motion
    is taken, else the first occurrence.
    """
    left = left.where(_small(F.col("ref_mv"))) if only_small else left
    at = [*keys, occurrence]
    if any_occurrence:
        # The first of each motion and the first of each key: two joins by equal keys, no candidate meets another.
        whole = F.struct(*[c for c in right.columns if c not in at])
        of_motion = right.groupBy(*keys, F.col("ref_mv").alias("_asked")).agg(F.min_by(whole, occurrence).alias("_same"))
        of_key = right.groupBy(*keys).agg(F.min_by(whole, occurrence).alias("_first"))
        asked = left.select(*at, F.col("ref_mv").alias("_asked"))
        found = asked.join(of_motion, [*keys, "_asked"], "left").join(of_key, keys)
        right = found.select(*at, F.coalesce("_same", "_first").alias("_found")).select(*at, "_found.*")
    zero = _small(F.col("a_ref_mv")) != F.col("b_zero")
    return field_diff(left, right, at, {"zero": zero, "motion": ~zero & _not_same("ref_mv")})


def saved_motion_diff(left: DataFrame, saved: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Colocated motion that was read, each different one of a key once, against what was saved for the key."""
    first = left.groupBy(*keys, "ref_mv").agg(F.min(line).alias(line))
    return field_diff(first, saved, keys, {"ref_mv": _not_same("ref_mv")})


def write_back_diff(direct: DataFrame, written: DataFrame, keys: list[str], third: DataFrame | None = None) -> DataFrame:
    """Direct sub-vectors (keys and part, dmv) against what was written (mv0, sub0); where a third side (mv) has the row, its vector decides."""
    at = [*keys, "part"]
    if third is not None:
        direct = direct.join(third.select(*at, F.col("mv").alias("third")), at, "left")
    own = _differ("b_mv0", "a_dmv") | _differ("b_sub0", "a_dmv")
    differs = own if third is None else F.when(F.col("a_third").isNotNull(), _differ("b_mv0", "a_third")).otherwise(own)
    return field_diff(direct, written, at, {"mv": differs}, "inner")


def _differ(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def mode_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """pred_delta and mode_delta of intra 8x8 blocks that both sides have."""
    both = field_diff(left, right, keys, {n: _not_same(n) for n in ("pred", "mode")}, "inner")
    return both.withColumn("pred_delta", F.col("a_pred") - F.col("b_pred")).withColumn("mode_delta", F.col("a_mode") - F.col("b_mode"))


def mode_array_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intra 4x4 modes: arrays of 16 (pred may be empty) against rows of (block, pred, mode); n_differing of the blocks that both have."""
    seen = F.transform(F.col("b_blocks"), lambda b: F.struct(F.get("a_mode", b["block"]).alias("mode"), F.get("a_pred", b["block"]).alias("pred"), b["mode"].alias("their_mode"), b["pred"].alias("their_pred")))
    wrong = F.filter(seen, lambda x: F.coalesce(x["mode"] != x["their_mode"], F.lit(False)) | F.coalesce(x["pred"] != x["their_pred"], F.lit(False)))
    theirs = right.groupBy(*keys).agg(F.collect_list(F.struct("block", "pred", "mode")).alias("blocks"))
    return _sided(left, keys, "a").join(_sided(theirs, keys, "b"), keys).select(*keys, F.size("b_blocks").cast("long").alias("n_blocks"), F.size(wrong).cast("long").alias("n_differing"))


def reconstruction_diff(left: DataFrame, right: DataFrame, keys: list[str], edges: list[str] | None = None) -> DataFrame:
    """out_delta, pred_delta, res_delta and, of the named sample arrays, the sum of absolute differences of the blocks of both sides.

    kind is mode where the modes differ, else what explains the error: a delta
    of more than twice the other, else mixed.
    """
    both = _sided(left, keys, "a").join(_sided(right, keys, "b").hint("merge"), keys)
    both = both.withColumn("out_delta", F.col("a_out") - F.col("b_out")).withColumn("pred_delta", F.col("a_pred") - F.col("b_pred"))
    both = both.withColumn("res_delta", F.col("out_delta") - F.col("pred_delta"))
    for e in edges or []:
        both = both.withColumn(f"{e}_delta", F.aggregate(F.zip_with(f"a_{e}", f"b_{e}", lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0))))
    return both.withColumn("kind", classify_delta(F.col("pred_delta"), F.col("res_delta"), _not_same("mode")))


def largest(rows: DataFrame, delta: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of the largest absolute delta."""
    return rows.orderBy(F.abs(F.col(delta)).desc(), *ties).limit(k)


def earliest_over(rows: DataFrame, kind: str, delta: str, order: list[str], threshold: int) -> DataFrame:
    """For each kind its rows (n) and the first one, by order, whose absolute delta reaches the threshold."""
    reached = F.when(F.abs(F.col(delta)) >= threshold, F.struct(*order, F.col(delta)))
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.min(reached).alias("_first")).select(kind, "n", *[F.col(f"_first.{c}").alias(c) for c in [*order, delta]])


def best_vector(blocks: DataFrame, candidates: DataFrame, keys: list[str], cost: Column, order: list[str]) -> DataFrame:
    """The candidate of the least cost for each block, ties by ``order``: a partial minimum, no sort."""
    tried = blocks.join(candidates.hint("merge"), keys).withColumn("_cost", cost)
    best = tried.groupBy(*keys).agg(F.min(F.struct(F.col("_cost").alias("cost"), *order)).alias("best"), F.count("*").alias("n_tried"))
    return best.select(*keys, "best.*", "n_tried")


def match_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The left rows that any right row equals in the keys."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def neutral_bound(samples: DataFrame, keys: list[str], value: Column, middle: int = 128, most: int = 3) -> DataFrame:
    """away, the largest distance from the neutral value, and whether it stays within ``most``."""
    return samples.groupBy(*keys).agg(F.max(F.abs(value - middle)).alias("away")).withColumn("neutral", F.col("away") <= most)


def richest(samples: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k keys with the most different values (n)."""
    return samples.groupBy(*keys).agg(F.countDistinct(value).alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def spatial_buckets(rows: DataFrame, x: str, y: str, size: int = 4) -> DataFrame:
    """bx, b_y and n of the squares of ``size`` samples that the rows lie in, with mean_x and mean_y of all rows.

    Every row counts; for the squares of the worst rows alone, pass the result of ``largest``.
    """
    at = rows.select(F.col(x).alias("x"), F.col(y).alias("y"))
    means = at.agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    counts = at.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("b_y")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(means))  # one row of means


def mode_summary(rows: DataFrame, modes: list[str]) -> DataFrame:
    """The six measures of the delta columns for each combination of modes."""
    total = lambda c, n: F.sum(F.col(c)).alias(n)
    size = lambda c, n: F.sum(F.abs(F.col(c))).alias(n)
    return rows.groupBy(*modes).agg(F.count("*").alias("n"), size("out_delta", "abs_out"), size("pred_delta", "abs_pred"), size("res_delta", "abs_res"), total("out_delta", "signed_out"), total("res_delta", "signed_res"))


def hash_check(files: DataFrame, expected: DataFrame, key: str, content: str, digest: str) -> DataFrame:
    """Each expected file's status by the SHA-256 of its content: equal, differs or missing."""
    found = files.select(key, F.sha2(F.col(content), 256).alias(digest))
    return field_diff(expected.select(key, digest), found, [key], {digest: _not_same(digest)})
