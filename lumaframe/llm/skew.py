"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in so many rows; so there are fewer hot keys than this.
PARTS = 1000


def _hot(counted: DataFrame, keys: list[str], count_col: str, total: int, parts: int) -> list[int]:
    """Hashes of the keys with more than one in ``parts`` of the rows: fewer than ``parts``, since the counts add up to ``total`` at most."""
    return [r.h for r in counted.where(F.col(count_col) * parts > total).select(F.xxhash64(*keys).alias("h")).distinct().collect()]


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count_col: str, total: int, parts: int = PARTS) -> DataFrame:
    """``rows`` joined with ``counted``, which has one row for each key and the number of its rows in ``count_col``.

    Hot keys' few rows of ``counted`` are broadcast, so that the rows of a hot
    key stay in the tasks that read them. All other keys hold a small part
    each and are joined by a shuffle. Both sides are split by the same hashes,
    so both ways together give each row once. ``rows`` is read twice where
    there is a hot key, so it should be a written table.
    """
    hot = _hot(counted, keys, count_col, total, parts)
    if not hot:
        return rows.join(counted, keys)
    few = lambda d, yes: d.where(F.xxhash64(*keys).isin(hot) == F.lit(yes))
    return few(rows, True).join(F.broadcast(few(counted, True)), keys).unionByName(few(rows, False).join(few(counted, False), keys))


def join_salted(rows: DataFrame, others: DataFrame, key: str, salt_by: str, names: DataFrame, total: int, parts: int = 256, spread: int = 64) -> DataFrame:
    """``rows`` joined with ``others``, one row a key and too large to broadcast.

    Keys with more than one in ``parts`` of the ``total`` rows are dealt over
    ``spread`` tasks by the hash of ``salt_by``, and their row of ``others`` is
    copied as often. ``names`` has the keys of ``rows``, one a row, in a
    written table. It is a merge join at every size.
    """
    is_hot = F.xxhash64(key).isin(_hot(names.groupBy(key).agg(F.count("*").alias("_n")), [key], "_n", total, parts))
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(salt_by), F.lit(spread)).cast("int")).otherwise(0))
    copied = others.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied.hint("merge"), [key, "_salt"]).drop("_salt")


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """``rows`` less most of those whose key is in no row of ``keys``; none that is in one goes.

    One bit for each hash of a key, 64 to a word: at most ``words`` rows of two
    longs are broadcast, whatever the size of ``keys``. The more keys, the
    fewer rows go, so an exact join has to follow.
    """
    shift = lambda name, value, n: F.call_function(name, value, n.cast("int"))
    place = lambda: F.pmod(F.xxhash64(key), F.lit(64 * words))
    bits = keys.select(place().alias("_h")).groupBy(F.expr("_h div 64").alias("_word")).agg(F.bit_or(shift("shiftleft", F.lit(1).cast("long"), F.col("_h") % 64)).alias("_bits"))
    tested = rows.withColumn("_h", place()).withColumn("_word", F.expr("_h div 64")).join(F.broadcast(bits), "_word")
    return tested.where(shift("shiftright", F.col("_bits"), F.col("_h") % 64).bitwiseAND(F.lit(1).cast("long")) == 1).drop("_h", "_word", "_bits")
