"""Line deduplication by overlapping three-line windows, found again anywhere in the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.scratch import Scratch
from lumaframe.llm.skew import join_counted

#: Lines in a window.
WINDOW = 3
_WORD = r"[^\x20\x09-\x0D]"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once for a row: a one-element transform binds it to a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, a, b): the line numbers and a 128-bit hash of each window of lines that have a word."""
    # Lines are hashed once; a window's hashes are made of its three lines' hashes.
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda s, i: F.when(s.rlike(_WORD), F.struct(i.alias("at"), F.xxhash64(s).alias("a"), F.xxhash64(F.lit(7), s).alias("b"))))
    found = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), lines.alias("_l"))

    def windows(solid: Column) -> Column:
        pick = lambda i: [F.get(solid, i + j) for j in range(WINDOW)]
        starts = F.when(F.size(solid) >= WINDOW, F.sequence(F.lit(0), F.size(solid) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.array(*[x["at"] for x in pick(i)]).alias("at"), F.xxhash64(*[x["a"] for x in pick(i)]).alias("a"), F.xxhash64(*[x["b"] for x in pick(i)]).alias("b")))

    return found.select("id", F.inline(_bound(F.filter("_l", lambda x: x.isNotNull()), windows)))


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, lines): the numbers, from 0, of the lines that later occurrences of windows cover.

    A window's first occurrence is the one of the smallest id and, in that
    document, the smallest line number. The first is kept; the positions of
    all others are merged.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    windows = scratch.write(_windows(docs, id_col, text_col), "windows")
    # Every window counts towards a partial minimum before the shuffle, so a passage in a third of all rows is one row a task.
    place = F.struct("id", F.get("at", F.lit(0)).alias("at"))
    found = windows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = join_counted(windows, scratch.write(found, "repeated"), ["a", "b"], "n", windows.count())
    places = again.where((F.col("id") != F.col("first.id")) | (F.get("at", F.lit(0)) != F.col("first.at"))).select("id", F.explode("at").alias("at"))
    return places.groupBy("id").agg(F.collect_set("at").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the lines that repeat an earlier three-line window, and with n_lines and n_removed.

    Lines are what lies between line feeds; windows are three consecutive
    lines that hold a word, compared exactly as they stand; lines of white
    space between them are skipped and stay. A document of fewer than three
    such lines has no window and stays whole. A null text stays null with
    n_lines null. Rows with a null id stay whole. Rows that repeat an id are
    one document: their windows are first together and go together. Existing
    columns named n_lines or n_removed are replaced; a document may become
    empty but its row stays. Work and memory are linear in a text's lines.
    """
    kept = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")])
    covered = covered_lines(kept, id_col, text_col, scratch).select(F.col("id").alias("_id"), F.col("lines").alias("_covered"))
    joined = kept.join(covered, F.col(id_col) == F.col("_id"), "left").drop("_id")

    def left(lines: Column) -> Column:
        # A set difference of line numbers keeps their order; a covered number past the end is one of a longer row of the same id.
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered"))
        return F.struct(F.size(lines).cast("long").alias("n"), (F.size(lines) - F.size(stay)).cast("long").alias("gone"), F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias("text"))

    text = F.col(text_col)
    cut = F.when(F.col("_covered").isNotNull() & text.isNotNull(), _bound(F.split(text, "\n"), left))
    joined = joined.withColumn("_cut", F.explode(F.array(cut)))  # a generated column is computed once, however often it is used
    made = {text_col: F.when(F.col("_cut").isNull(), text).otherwise(F.col("_cut.text"))}
    n_lines = F.coalesce(F.col("_cut.n"), F.size(F.split(text, "\n")).cast("long"))
    n_removed = F.coalesce(F.col("_cut.gone"), F.lit(0).cast("long"))
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in kept.columns], *[F.when(text.isNotNull(), x).alias(n) for x, n in ((n_lines, "n_lines"), (n_removed, "n_removed"))])
