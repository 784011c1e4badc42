"""Interleaving sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
import math
import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Slots in a period: target weights are rounded to this many parts (or to four for each source, if that is more).
PERIOD = 1000
#: Rows of a source are numbered in hash buckets: at least so many, and more where a bucket would get over BUCKET_ROWS rows.
BUCKETS = 1024
BUCKET_ROWS = 1 << 14
#: Up to so many sources, each end of a source begins a new stretch; of more, a quarter has to end first.
SINGLE_ENDS = 32
#: Tables of the schedule with more rows than this are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Without target weights, a source's weight is its number of rows to this power.
TEMPERATURE = 0.5


def whole_weights(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer weights of sum ``period``, at least 1 each, by largest remainders."""
    total = math.fsum(weights.values())
    spare = period - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    parts = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(parts.values())]:
        parts[s] += 1
    return parts


def pfair_period(weights: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(source, release, deadline, slot) of every block in one period.

    Block i of a source of weight w / W may start at floor(i W / w) and is due
    at ceil((i + 1) W / w). Earliest deadline first fills every slot, meets
    every deadline and starts no block early, so at any time a source is less
    than one block away from its share; at the period's end it has exactly its
    share, and periods can be repeated side by side.
    """
    period = sum(weights.values())
    blocks = sorted((i * period // w, -(-(i + 1) * period // w), s) for s, w in weights.items() for i in range(w))
    ready: list[tuple[int, int, str]] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(blocks) and blocks[at][0] <= slot:
            heapq.heappush(ready, (blocks[at][1], blocks[at][0], blocks[at][2]))
            at += 1
        due, release, source = heapq.heappop(ready)
        out.append((source, release, due, slot))
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float], start: int = 0) -> tuple[list[tuple], list[tuple], int]:
    """Stretches and slots for sources with so many blocks; where it ends.

    While all sources last, whole periods repeat. When one has less than its
    part of a period left, a last, shorter period uses it up, and the others go
    on at their weights relative to each other. Of more than SINGLE_ENDS
    sources, a quarter has to end before the others get new shares; till then
    the slots of those that ended stay empty. So plans are made for fewer and
    fewer sources and their slots are linear in the sources. Stretches: (plan,
    source, first block, end block, blocks a period, start slot, period).
    Slots: (plan, source, block in the period, slot, release, deadline).
    """
    left, taken = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    stretches, slots, number = [], [], 0

    def stretch(plan: int, each: dict[str, int], periods: int, period: int) -> None:
        nonlocal start
        for s, n in each.items():
            use = min(left[s], n * periods)
            if use:
                stretches.append((plan, s, taken[s], taken[s] + use, n, start, period))
            taken[s] += use
            left[s] -= use
        start += periods * period

    while left:
        share = whole_weights({s: weights[s] for s in left}, max(PERIOD, 4 * len(left)))
        plan = pfair_period(share)
        whole = min(n // share[s] for s, n in left.items())
        ends = sorted(-(-n // share[s]) for s, n in left.items())
        last = ends[0 if len(left) <= SINGLE_ENDS else len(left) // 4]
        if whole or last > 1:
            used = dict.fromkeys(left, 0)
            for source, release, due, slot in plan:
                slots.append((number, source, used[source], slot, release, due))
                used[source] += 1
            if whole:
                stretch(number, share, whole, len(plan))
            if last - whole > 1:
                stretch(number, share, last - whole, len(plan))
            number += 1
        if last - whole == 1:  # the only period in which sources run out: no slot stays empty
            take, used, order = {s: min(share[s], n) for s, n in left.items()}, dict.fromkeys(left, 0), 0
            for source, release, due, _ in plan:
                if used[source] < take[source]:
                    slots.append((number, source, used[source], order, release, due))
                    used[source] += 1
                    order += 1
            stretch(number, take, 1, order)
            number += 1
        left = {s: n for s, n in left.items() if n}
    return stretches, slots, start


def _source(source_col: str) -> Column:
    """Sources as text that tells null from any name."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", *, block_rows: int = 16) -> DataFrame:
    """``docs`` with mix_block, mix_slot, mix_release, mix_deadline and mix_position (long).

    Each source's rows, in an order by hash, form blocks of ``block_rows``
    (the last may be shorter). Blocks are put into slots so that, as long as
    all sources last, the first n slots hold less than one block more or less
    than n times its weight of each source; release and deadline are the slots
    within its period that the block may start and must end by. A source that
    ends leaves its part to the others. Sorting by mix_position gives the
    mixture; every row is in it once. Sources without a positive target weight
    come after all others, by their sizes. Without ``weights``, weights are
    row counts to the power TEMPERATURE.

    A null source is a source of its own; null or repeated ids and repeated
    rows keep their rows. Rows of one id are ordered by a hash of all their
    columns, so that a task that runs again gives them the same places; rows
    without id are dealt by that hash. Existing columns of these names are
    replaced. The driver gets one count for each source and makes a schedule
    whose slots are linear in the sources; it is joined to blocks, by
    broadcast up to BROADCAST_ROWS rows and by a shuffle beyond.
    """
    spark = docs.sparkSession
    made = ["mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"]
    kept = [c for c in docs.columns if c not in made]
    hashable = [c for c in kept if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    rows = docs.select(*kept, _source(source_col).alias("_source"))

    counts = {r["_source"]: r["_n"] for r in rows.groupBy("_source").agg(F.count("*").alias("_n")).orderBy("_source").collect()}
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    if weights is None:
        stretches, slots, _ = schedule(blocks, {s: n**TEMPERATURE for s, n in counts.items()})
    else:
        named = {"null" if s is None else f"={s}": w for s, w in weights.items() if w > 0}
        stretches, slots, end = schedule({s: n for s, n in blocks.items() if s in named}, named)
        more, places, _ = schedule({s: n for s, n in blocks.items() if s not in named}, counts, end)
        base = 1 + max((x[0] for x in stretches), default=-1)
        stretches, slots = stretches + [(x[0] + base, *x[1:]) for x in more], slots + [(x[0] + base, *x[1:]) for x in places]

    def sized(table: list[tuple], schema: str) -> DataFrame:
        frame = spark.createDataFrame(table, schema)
        return F.broadcast(frame) if len(table) <= BROADCAST_ROWS else frame.hint("merge")

    stretch = sized(stretches, "_plan int, _of string, _first long, _end long, _each long, _start long, _period long")
    slot = sized(slots, "_plan int, _source string, _i long, _at long, mix_release long, mix_deadline long")

    buckets = BUCKETS
    while buckets * BUCKET_ROWS < max(counts.values(), default=0):
        buckets *= 2
    dealt_by = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(*hashable))
    rows = rows.withColumn("_bucket", F.pmod(dealt_by, F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("_source", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_rank", F.row_number().over(_order(id_col, hashable))).join(offset.hint("merge"), ["_source", "_bucket"])
    numbered = numbered.withColumn("_seq", F.col("_before") + F.col("_rank") - 1).drop("_before", "_rank", "_bucket")
    numbered = numbered.withColumn("mix_block", F.expr(f"_seq div {block_rows}"))
    inside = (F.col("mix_block") >= F.col("_first")) & (F.col("mix_block") < F.col("_end"))
    placed = numbered.join(stretch, (F.col("_source") == F.col("_of")) & inside).drop("_of")
    placed = placed.withColumn("_i", (F.col("mix_block") - F.col("_first")) % F.col("_each")).withColumn("_turn", F.expr("(mix_block - _first) div _each"))
    placed = placed.join(slot, ["_plan", "_source", "_i"])
    mixed = placed.withColumn("mix_slot", F.col("_start") + F.col("_turn") * F.col("_period") + F.col("_at"))
    return mixed.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("_seq") % block_rows).select(*kept, *made)


def _order(id_col: str, columns: list[str]) -> WindowSpec:
    return Window.partitionBy("_source", "_bucket").orderBy(F.xxhash64(id_col), id_col, F.xxhash64(*columns))


def _ranged(rows: DataFrame, keys: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """The rows range-partitioned and sorted by mix_position, to be written in that order."""
    return _ranged(mixed, ["mix_position"])


def in_written_order(docs: DataFrame) -> DataFrame:
    """The rows of a table that was written in order, range-partitioned and sorted by file, place of the split and row.

    Scans deal files out by size and cut large ones; the numbers of the files
    that a sorted write makes, and the rows inside each, keep the order.
    A frame that reads no file has the order of its partitions.
    """
    place = docs.select("*", F.input_file_name().alias("_file"), F.input_file_block_start().alias("_split"), F.monotonically_increasing_id().alias("_row"))
    return _ranged(place, ["_file", "_split", "_row"]).drop("_file", "_split", "_row")
