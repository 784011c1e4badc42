"""What each filter of a chain removes in every order of the chain, walked by adjacent swaps.

Spark counts the documents of each part by the set of filters that they fail,
a cell for each set. Everything about any order follows from these cells, so
one task handles a part's at most 2^k cells, whatever its number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Filters in a chain, at most: there are k! orders, so a part has 8! * 8 rows at most.
MOST = 8
#: Parts whose orders are made at once.
_PARTS = 16


def adjacent_swaps(k: int) -> Iterator[int]:
    """Positions to swap with the next one so that all orders of k things are visited, each once."""
    # Johnson and Trotter: the largest thing that can move in its direction moves; all larger ones then turn round.
    order, to = list(range(k)), [-1] * k
    while True:
        for thing in range(k - 1, -1, -1):
            at = order.index(thing)
            other = at + to[thing]
            if 0 <= other < k and order[other] < thing:
                break
        else:
            return
        order[at], order[other] = order[other], order[at]
        for larger in range(thing + 1, k):
            to[larger] = -to[larger]
        yield min(at, other)


def walk(cells: np.ndarray, k: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(order, kept, removed, running sum of removals by filter) at every order.

    ``cells`` has the shape (parts, 2^k, measures); ``kept`` is (parts, k) of
    the first measure, ``removed`` (parts, k, measures), the sum (parts, k).
    A swap changes what two steps see, so only those two are read again.
    """
    masks = np.arange(1 << k)

    def step(before: int, one: int) -> tuple[np.ndarray, np.ndarray]:
        untouched = masks & before == 0
        return cells[:, untouched & (masks >> one & 1 == 0), 0].sum(axis=1), cells[:, untouched & (masks >> one & 1 == 1)].sum(axis=1)

    order = list(range(k))
    kept, removed = np.zeros((len(cells), k), np.int64), np.zeros((len(cells), k, cells.shape[2]), np.int64)
    now = np.zeros((len(cells), k), np.int64)
    total = np.zeros((len(cells), k), np.int64)

    def refresh(positions: list[int]) -> None:
        before = sum(1 << one for one in order[: positions[0]])
        for at in positions:
            kept[:, at], removed[:, at] = step(before, order[at])
            now[:, order[at]] = removed[:, at, 0]
            before |= 1 << order[at]

    refresh(list(range(k)))
    total += now
    yield order, kept, removed, total
    for at in adjacent_swaps(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        refresh([at, at + 1])
        total += now
        yield order, kept, removed, total


def _orders(batches: Iterator[pa.RecordBatch], names: list[str], lost: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    k = len(names)
    masks = np.arange(1 << k)
    for whole in batches:
        for begin in range(0, whole.num_rows, _PARTS):
            batch = whole.slice(begin, _PARTS)
            cells = np.zeros((batch.num_rows, 1 << k, 1 + len(lost)), np.int64)
            for n, found in enumerate(batch.column("cells").to_pylist()):
                for cell in found:
                    cells[n, cell["mask"]] += [cell["n"], *(cell[c] for c in lost)]
            failing = np.stack([cells[:, masks >> f & 1 == 1, 0].sum(axis=1) for f in range(k)], axis=1)
            alone = np.stack([cells[:, 1 << f, 0] for f in range(k)], axis=1)
            labels, orders, keeps, gone, total = [], [], [], [], None
            for order, kept, removed, total in walk(cells, k):  # noqa: B007
                labels.append("".join(names[f] for f in order))
                orders.append(list(order))
                keeps.append(kept.copy())
                gone.append(removed.copy())
            at = np.array(orders)
            keeps, gone = np.stack(keeps, axis=1), np.stack(gone, axis=1)
            rows = at.size
            for n in range(batch.num_rows):
                removed = gone[n].reshape(rows, -1)
                made = {
                    "part": pa.array([batch.column("part")[n].as_py()] * rows, pa.string()),
                    "filter_order": pa.array(np.repeat(labels, k)),
                    "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(labels))),
                    "kept": keeps[n].reshape(-1),
                    "removed": removed[:, 0],
                    "redundant": failing[n][at].reshape(-1) - removed[:, 0],
                    "unique_fails": alone[n][at].reshape(-1),
                    **{c: removed[:, 1 + i] for i, c in enumerate(lost)},
                    "shapley": total[n][at].reshape(-1),
                }
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name]).cast(f.type) for f in schema], schema=schema)


def audit(cells: DataFrame, filters: list[str], lost: list[str]) -> DataFrame:
    """Every order of ``filters`` over the documents counted in ``cells``.

    ``cells`` has part (string), mask (int: bit i is set where the i-th filter
    fails), n (long) and a long column for each name in ``lost``: documents,
    and those of them whose loss is to be told apart. Rows of one part and
    mask are added up. The result has, for each part, order (the filters'
    one-letter names in a row) and step: kept, removed, redundant, unique_fails,
    the columns of ``lost`` and shapley, which is the filter's removals summed
    over all orders; by the number of orders it is the Shapley value. No part,
    no rows. More than MOST filters are refused.
    """
    if not 0 < len(filters) <= MOST or len({*filters}) < len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST} filters with different names of one letter, got {filters}")
    summed = cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", *lost)])
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *lost)).alias("cells"))
    longs = ["kept", "removed", "redundant", "unique_fails", *lost, "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in longs]])
    arrow = to_arrow_schema(schema)
    return parts.mapInArrow(lambda batches: _orders(batches, filters, lost, arrow), schema)


#: What a text fails the five filters of the corpus audit by, but for the last one, which is a repeated text.
_WORD = r"[^\x20\x09-\x0D]+"
FILTERS = ["A", "B", "C", "D", "E"]


def text_failures(text: Column, words: Column) -> Column:
    """The bits of filters A to D: under 100 words, few distinct words, many capitals, odd characters."""
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals.cast("long") > 10 * F.char_length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def corpus_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` counted by part (their lang) and the set of filters A to E that they fail.

    Null texts are empty texts, a null lang is the empty string. Filter E fails
    where a smaller doc_id has the same text; a row without doc_id neither
    fails it nor makes others fail. Rows that repeat an id are documents of
    their own that do not fail E by each other. A document counts as good or
    toxic if any of its rows in ``labels`` says so; labels of no document and
    null labels count nothing. Texts do not travel: rows that are shuffled hold
    a text's SHA-256, and equal ones are counted before they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = seen.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    seen = seen.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_failures(F.col("text"), F.col("words")).alias("mask"))
    group = ["same", "part", "mask"]
    without_id = seen.where("id IS NULL").groupBy(*group).agg(F.count("*").alias("n"))
    rows = seen.where("id IS NOT NULL").groupBy("id", *group).agg(F.count("*").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    # Two tables that grow: a merge join at every size.
    rows = rows.join(known.hint("merge"), "id", "left").fillna(0, ["quality", "toxic"])
    merged = rows.groupBy(*group, "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    none = F.lit(0)
    merged = merged.unionByName(without_id.select(*group, none.alias("quality"), none.alias("toxic"), "n", F.lit(None).cast(merged.schema["first"].dataType).alias("first")))
    # A text has at most four rows a part here, so its window is bounded by the parts, not by its copies.
    least = F.min("first.id").over(Window.partitionBy("same"))
    merged = merged.withColumn("least", least)
    passing = F.when(F.col("first").isNull(), F.col("n")).when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - passing).alias("n")))
    split = merged.select("part", "quality", "toxic", F.inline(both))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good_lost"), F.sum(F.col("n") * F.col("toxic")).alias("toxic_lost"))


def audit_corpus(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters for each lang; see ``audit`` and ``corpus_cells``.

    Empty tables give no rows. Other columns of ``docs`` and ``labels`` are
    not read, so their names do not matter.
    """
    return audit(corpus_cells(docs, labels), FILTERS, ["good_lost", "toxic_lost"])


def oracle() -> str:
    """The same rows as SQL for DuckDB, each step counted by itself from all documents."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
        WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        flags AS (SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t,
                         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM texts),
        marked AS (SELECT part, doc_id, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
                          100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, e FROM flags),
        docs AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
                        || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
                        EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND toxic = 1) AS bad FROM marked m),
        cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad FROM docs GROUP BY 1, 2),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM {letters} a(f), {letters} b(f), {letters} c(f), {letters} d(f), {letters} e(f)
                   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT filter_order, step, filter_order[step] AS f, '[' || filter_order[:step] || ']' AS upto, CASE WHEN step = 1 THEN '$x' ELSE '[' || filter_order[:step - 1] || ']' END AS before
                  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
        counted AS (SELECT part, filter_order, step, f,
                           coalesce(sum(n) FILTER (WHERE NOT regexp_matches(fails, upto)), 0) AS kept,
                           coalesce(sum(n) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS removed,
                           coalesce(sum(n) FILTER (WHERE contains(fails, f) AND regexp_matches(fails, before)), 0) AS redundant,
                           coalesce(sum(n) FILTER (WHERE fails = f), 0) AS unique_fails,
                           coalesce(sum(good) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS good_lost,
                           coalesce(sum(bad) FILTER (WHERE contains(fails, f) AND NOT regexp_matches(fails, before)), 0) AS toxic_lost
                    FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted"""
