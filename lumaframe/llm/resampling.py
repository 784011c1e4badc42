"""Importance resampling of documents towards a target corpus, by hashed n-grams.

Texts are read twice, where they lie: once to count each bucket's features in
both corpora, once to add up each document's gains. Between the two stand the
counts of the buckets. Words are handled as integers: a block of texts has a
dictionary of its distinct words, an n-gram is a tuple of their ids, and each
distinct tuple's bytes are put together and hashed once a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.scratch import Scratch
from lumaframe.llm.shingles import _LOWER, text_slices

#: What lies between words: all of ASCII but digits and lower-case letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Values of the random draw's integer.
_RANGE = 4294967296


def word_ids(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, each word's id in order of the texts, each text's number of words); A-Z count as a-z, null texts have no words."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if not len(whole) or offsets[-1] == offsets[0]:
        return [], np.zeros(0, np.int64), np.zeros(len(whole), np.int64)
    # Lowered from the buffers: the compute function for it goes wrong on sliced arrays.
    lowered = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]]
    cut = pc.split_pattern_regex(pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(lowered)), _BETWEEN)
    pieces = cut.flatten()
    real = pc.greater(pc.binary_length(pieces), 0)
    counts = np.add.reduceat(real.to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(cut.offsets)[:-1])  # a split text has one piece at least
    coded = pieces.filter(real).cast(pa.large_binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def ngram_buckets(words: list[bytes], ids: np.ndarray, counts: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every run of 1 to ``longest`` words inside a text.

    A run is a tuple of ids, told from others by the number of its first
    n - 1 ids' tuple and its last id. Every distinct tuple is hashed once.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    single = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    found, texts = [single[ids]] if len(ids) else [np.zeros(0, np.int64)], [owner]
    starts, tuples = np.arange(len(ids)), ids
    for n in range(2, longest + 1):
        # Starts whose run of n words still lies in one text; their tuple of n - 1 words is known.
        inside = (starts + n - 1 < len(ids)) & (owner[np.minimum(starts + n - 1, max(0, len(ids) - 1))] == owner[starts]) if len(starts) else np.zeros(0, bool)
        starts, tuples = starts[inside], tuples[inside]
        distinct, first, tuples = np.unique(tuples * (len(words) + 1) + ids[starts + n - 1], return_index=True, return_inverse=True)
        hashed = np.array([zlib.crc32(b" ".join(words[i] for i in ids[starts[at] : starts[at] + n])) % buckets for at in first.tolist()], np.int64)
        found.append(hashed[tuples] if len(distinct) else np.zeros(0, np.int64))
        texts.append(owner[starts])
    return np.concatenate(found), np.concatenate(texts)


def _count(batches: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)  # a task sends one row for each bucket it met
    for batch in batches:
        for part in text_slices(batch, "text"):
            total += np.bincount(ngram_buckets(*word_ids(part.column("text")), longest, buckets)[0], minlength=buckets)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])


def _weigh(batches: Iterator[pa.RecordBatch], longest: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "text"):
            words, ids, counts = word_ids(part.column("text"))
            bucket, text = ngram_buckets(words, ids, counts, longest, len(gains))
            weight, features = np.zeros(part.num_rows, np.int64), np.bincount(text, minlength=part.num_rows)
            np.add.at(weight, text, gains[bucket])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(features), pa.array(weight), pa.array(counts)], names=["id", "n_features", "weight", "n_words"])


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = 10000) -> DataFrame:
    """(bucket, n): features of all texts by the CRC-32 of their bytes."""
    made = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: _count(b, longest, buckets), "bucket long, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000) -> np.ndarray:
    """A thousand times the log of each bucket's share in ``target`` over its share in ``docs``, one added to each count, floored.

    At most ``buckets`` rows of either corpus' counts come to the driver.
    """
    counts = np.zeros((2, buckets), np.int64)
    both = bucket_counts(docs, longest=longest, buckets=buckets).withColumn("k", F.lit(0)).unionByName(bucket_counts(target, longest=longest, buckets=buckets).withColumn("k", F.lit(1)))
    for r in both.collect():
        counts[r.k, r.bucket] = r.n
    (s, t), (all_s, all_t) = counts.astype(np.float64), counts.sum(axis=1).astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, buckets: int = 10000, percent: int = 10, least: int = 20, seed: int = 2024, scratch: Scratch | None = None) -> DataFrame:
    """Every document with n_features, weight, score and rank, its place among the drawn ones, null where it is not drawn.

    Features are all runs of 1 to ``longest`` words. A document's weight is the
    sum of its features' gains; its score adds Gumbel noise that only its id
    and ``seed`` decide, so the highest scores are a draw without replacement
    in proportion to the weights' exponentials. Of the documents of at least
    ``least`` words, ``percent`` in a hundred are drawn. Null and empty texts
    have no features and weight 0. Rows without id have no score, are not
    drawn and do not count among those drawn from. Rows that repeat an id are
    documents of their own with the same noise; equal scores go to the smaller
    id, then to the smaller n_features. Other columns are not read. An empty
    table gives an empty table, an empty target the gains of its empty counts.
    Two narrow tables are written: the scores, and the scores in order.
    """
    if not 0 <= percent <= 100 or longest < 1 or buckets < 1:
        raise ValueError("percent must lie in 0 to 100, longest and buckets from 1")
    scratch = scratch or Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gains = bucket_gains(texts, target.select(F.col(text_col).cast("string").alias("text")), longest, buckets)
    kind = texts.schema["id"].dataType.simpleString()
    weighed = texts.mapInArrow(lambda b: _weigh(b, longest, gains), f"id {kind}, n_features long, weight long, n_words long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(_RANGE)))))
    scored = weighed.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("id").isNotNull() & (F.col("n_words") >= least)).alias("may"))
    scored = scratch.write(scored, "scores")
    # Ranks of a table of any size: sorted ranges, their counts, then places inside each range.
    order = [F.col("may").desc(), F.col("score").desc(), F.col("id"), F.col("n_features"), F.col("weight")]
    ranges = scratch.write(scored.orderBy(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = {r.range: r.n for r in ranges.where("may").groupBy("range").agg(F.count("*").alias("n")).collect()}
    drawn, before, offsets = sum(sizes.values()) * percent // 100, 0, []
    for r in sorted(sizes):  # as many as the sort has partitions
        offsets.append((r, before))
        before += sizes[r]
    first = docs.sparkSession.createDataFrame(offsets, "range int, before long")
    placed = ranges.join(F.broadcast(first), "range", "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("may") & (place <= drawn), place).cast("long").alias("rank"))


def oracle() -> str:
    """The query's rows as SQL for DuckDB, with CRC-32 as a fold over bytes."""
    table = "(SELECT list(e ORDER BY i) FROM (SELECT i, list_reduce([i] || [1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e FROM range(256) r(i)))"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH crc AS (SELECT {table} AS tbl),
        d AS (SELECT doc_id, {words} AS w FROM documents),
        dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2),
        tw AS (SELECT w, count(*) AS n FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY 1),
        vocabulary AS (SELECT w, string_split(hex(encode(w)), '') AS x FROM (SELECT w FROM dw UNION SELECT w FROM tw)),
        hashed AS (SELECT w, xor(list_reduce([4294967295] || [(position(x[2 * i + 1] IN '0123456789ABCDEF') - 1) * 16 + position(x[2 * i + 2] IN '0123456789ABCDEF') - 1 FOR i IN range(len(x) // 2)],
                          lambda c, b: xor(c >> 8, tbl[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM vocabulary, crc),
        s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY 1),
        t AS (SELECT bucket, sum(n) AS t FROM tw JOIN hashed USING (w) GROUP BY 1),
        gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
        weights AS (SELECT doc_id, sum(n * gain) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (SELECT doc_id, len(w) AS n, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n >= 20) AS total FROM scored)
        SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n >= 20 AND r <= total * 10 // 100 THEN r::BIGINT END AS rank FROM placed"""
