"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional codewords are trained on a bounded sample:
k-means on residuals first, then rounds of beam-search encoding and a joint
least-squares update of all codewords. Every distinct vector is encoded by
beam search and stored as one byte for each codebook, three norms (see
stored_norms) and the vector itself. A query scores codes by adding table
entries; over the stored length that is an approximate cosine, and the codes
of the largest ones are its shortlist. What is left of a vector stands at a
right angle to its reconstruction, which bounds how far a score is off; of the
shortlist, what may reach the query's best so far is ranked by its exact
cosine.

Queries form groups and code blocks form slices. A task holds one group's
queries and has one slice's blocks stream past, so a code block travels once
for each group and a query once for each slice, and no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaframe.llm.scratch import Scratch

CODEBOOKS, CODEWORDS, BEAM = 8, 256, 4
#: Vectors that the codebooks are fitted on, at most: those of the smallest id hashes.
SAMPLE = 8192
#: Codes in a block, code blocks in a slice, queries in a group (all about) and queries scored at once.
CODE_BLOCK, SLICE, GROUP, QUERIES = 2048, 512, 16384, 256
#: Part of each block of codes that a query ranks exactly for their scores alone, and pairs multiplied at once.
SHARE, PAIRS = 0.05, 1 << 16
#: What single-precision scores, and double-precision products of unit vectors, may be off besides.
SLACK, ROUNDING = 1e-4, 1e-9


def train_codebooks(x: np.ndarray, books: int = CODEBOOKS, words: int = CODEWORDS, rounds: int = 2) -> np.ndarray:
    """(books, words, dimensions) codewords for the rows of x."""
    rng = np.random.default_rng(7)
    words = max(1, min(words, len(x) // 2))
    out = np.zeros((books, words, x.shape[1]), np.float32)
    rest = x.astype(np.float32).copy()
    for book in out:
        book[:] = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(6):
            near = (rest @ book.T - (book**2).sum(1) / 2).argmax(1)
            sums = np.zeros_like(book)
            np.add.at(sums, near, rest)
            n = np.bincount(near, minlength=words)[:, None]
            book[:] = np.where(n > 0, sums / np.maximum(n, 1), rest[rng.choice(len(rest), words)])
        rest -= book[(rest @ book.T - (book**2).sum(1) / 2).argmax(1)]
    for _ in range(rounds):
        codes = encode(x, out) + np.arange(books) * words
        gram, target = np.zeros((books * words, books * words), np.float32), np.zeros((books * words, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(target, codes[:, i], x)
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1)
        # A little weight on the present codewords keeps rarely used ones where they are.
        flat = out.reshape(-1, x.shape[1])
        flat[:] = np.linalg.solve(gram + 0.1 * np.eye(len(gram), dtype=np.float32), target + 0.1 * flat)
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, block: int = 1024) -> np.ndarray:
    """Codes by beam search: after each codebook the ``beam`` partial sums nearest to the vector go on."""
    m, k, _ = books.shape
    halves = (books**2).sum(2) / 2
    cross = [[books[i] @ books[j].T for j in range(i)] for i in range(m)]
    out = np.empty((len(x), m), np.int64)
    for at in range(0, len(x), block):
        part = np.asarray(x[at : at + block], np.float32)
        rows = np.arange(len(part))[:, None]
        codes, loss = np.zeros((len(part), 1, m), np.int64), np.zeros((len(part), 1), np.float32)
        for i in range(m):
            cost = loss[:, :, None] + (halves[i] - part @ books[i].T)[:, None, :]
            for j in range(i):
                cost += cross[i][j].T[codes[:, :, j]]
            flat = cost.reshape(len(part), -1)
            best = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
            codes = codes[rows, best // k]
            codes[:, :, i] = best % k
            loss = flat[rows, best]
        out[at : at + block] = codes[rows[:, 0], loss.argmin(1)]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.float32:
        flat = flat.astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _double_unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return _double_unit(x).astype(np.float32)


def stored_norms(units: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each code the length of its reconstruction, the factor that brings that nearest to the vector, and the length of what then is left, at a right angle to it."""
    made = sum(books[i][codes[:, i]] for i in range(len(books)))
    length = np.maximum(np.linalg.norm(made, axis=1), 1e-6)
    scale = (units * made).sum(1) / length**2
    return np.stack([length, scale, np.linalg.norm(units - scale[:, None] * made, axis=1)], axis=1).astype(np.float32)


def _encoded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def block(full: bool) -> Iterator[pa.RecordBatch]:
        while held and (sum(len(h[0]) for h in held) >= CODE_BLOCK or not full):
            made = [np.concatenate([h[i] for h in held]) for i in range(4)]
            held.clear()
            for at in range(0, len(made[0]), CODE_BLOCK):
                part = [x[at : at + CODE_BLOCK] for x in made]
                if full and len(part[0]) < CODE_BLOCK:
                    held.append(tuple(part))
                else:
                    yield pa.RecordBatch.from_pylist([{name: x.tobytes() for name, x in zip(("ids", "codes", "norms", "originals"), (part[0], part[1], part[2].T, part[3]), strict=True)}])

    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            vectors = _matrix(part.column("vector"))
            codes = encode(_unit(vectors), books)
            held.append((part.column("rep").to_numpy(), codes.astype(np.uint8), stored_norms(_unit(vectors), codes, books), vectors))
            yield from block(True)
    yield from block(False)


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _matrix(batch.column("vector"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["id", "vector"])


def _original(raw: bytes, rows: int, d: int) -> np.ndarray:
    """Single or double precision, as the column had it."""
    return np.frombuffer(raw, np.float32 if len(raw) == rows * d * 4 else np.float64).reshape(rows, d).astype(np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the vector a and the rows of b, in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def _floor(scores: np.ndarray, n: int) -> np.ndarray:
    """The n-th best of each row."""
    return -np.partition(-scores, n - 1, axis=1)[:, n - 1] if scores.shape[1] >= n else np.full(len(scores), -np.inf)


class _Group:
    """The n best of each query of a group by exact cosine, ties to the smaller id, over the code blocks seen; with ``exact`` nothing that can matter is left out."""

    def __init__(self, ids: list[int], vectors: list[bytes], books: np.ndarray, n: int, exact: bool):
        self.ids, self.books, self.n, self.exact, self.multiplied = np.array(ids, np.int64), books, n, exact, 0
        self.asked = np.concatenate([_original(v, 1, books.shape[2]) for v in vectors])
        self.unit = _double_unit(self.asked)
        self.scores, self.known = np.full((len(ids), n), -np.inf), np.full((len(ids), n), -1)
        self.near = np.full((len(ids), n), -np.inf, np.float32)  # the approximate cosine of each of the best

    def see(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, originals: np.ndarray) -> None:
        """Rerank exactly each query's shortlist of these codes, less what the stored norms rule out."""
        units, (length, scale, rest) = _double_unit(originals), norms
        short = len(codes) if self.exact else min(len(codes), max(self.n, int(np.ceil(SHARE * len(codes)))))
        for at in range(0, len(self.ids), QUERIES):
            part = slice(at, at + QUERIES)
            unit, scores = self.unit[part], self.scores[part]
            dots = np.zeros((len(unit), len(codes)), np.float32)
            for i, book in enumerate(self.books):
                dots += (unit.astype(np.float32) @ book.T)[:, codes[:, i]]
            near = dots / length
            # The product is off by the rest's length times the sine of the query's angle to the reconstruction, at most.
            off = np.sqrt(np.maximum(0, 1 - near**2)) * rest + np.float32(SLACK)
            most = dots * scale + off
            reach = most >= np.maximum(scores[:, -1], _floor(most - 2 * off, self.n))[:, None]
            if short == len(codes):
                self._rank(part, reach, near, ids, units, originals)
                continue
            listed = np.zeros_like(reach)
            np.put_along_axis(listed, np.argpartition(-near, short - 1, axis=1)[:, :short], True, axis=1)
            self._rank(part, reach & listed, near, ids, units, originals)
            # Codes that look as near as the best ones found do: a group of like vectors is not cut by the share.
            alike = near + np.float32(SLACK) >= self.near[part].min(axis=1)[:, None]
            self._rank(part, reach & alike & ~listed, near, ids, units, originals)

    def _rank(self, part: slice, reach: np.ndarray, near: np.ndarray, ids: np.ndarray, units: np.ndarray, originals: np.ndarray) -> None:
        scores, known, looks = self.scores[part], self.known[part], self.near[part]
        who, which = np.nonzero(reach)
        self.multiplied += len(who)
        close = np.full(reach.shape, -np.inf)
        for at in range(0, len(who), PAIRS):
            i, j = who[at : at + PAIRS], which[at : at + PAIRS]
            close[i, j] = np.einsum("pd,pd->p", self.unit[part][i], units[j])
        reach = close >= np.maximum(scores[:, -1], _floor(close, self.n))[:, None] - ROUNDING
        for i in np.flatnonzero((reach & np.isfinite(close)).any(1)):
            own = np.flatnonzero(reach[i] & np.isfinite(close[i]))
            every, names, look = np.concatenate([scores[i], _cosines(self.asked[part][i], originals[own])]), np.concatenate([known[i], ids[own]]), np.concatenate([looks[i], near[i, own]])
            order = np.lexsort((names, -every))[: self.n]
            scores[i], known[i], looks[i] = every[order], names[order], look[order]

    def rows(self) -> pa.RecordBatch:
        held = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, held.sum(1))), pa.array(self.known[held]), pa.array(self.scores[held])], names=["query_id", "rep", "score"])


def _scored(batches: Iterator[pa.RecordBatch], books: np.ndarray, n: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a lane: its queries first (without codes), then its code blocks."""
    m, _, d = books.shape
    single = lambda raw: np.frombuffer(raw, np.float32)
    lane, ids, vectors, group = None, [], [], None
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            if row["lane"] != lane:
                if group is not None:
                    yield group.rows()
                lane, ids, vectors, group = row["lane"], [], [], None
            if row["codes"] is None:
                ids.append(row["id"])
                vectors.append(row["originals"])
            elif ids:
                group = group or _Group(ids, vectors, books, n, exact)
                names = np.frombuffer(row["ids"], np.int64)
                group.see(names, np.frombuffer(row["codes"], np.uint8).reshape(-1, m), single(row["norms"]).reshape(3, -1), _original(row["originals"], len(names), d))
    if group is not None:
        yield group.rows()


def usable(vector: Column) -> Column:
    """Not null, not zero, nothing null or non-finite inside."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 5, exact: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank from 1, id_col, score): the k nearest by cosine of each row for which ``queries`` holds.

    Candidates are all rows but the query's own id, ties go to the smaller
    id. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do null ids, nor vectors of another length
    than most have (the shorter of two equally frequent lengths). Rows that
    repeat an id and its vector count once; an id with several vectors is a
    candidate by each, and a query by the smallest of them. Equal vectors are
    indexed once, by their smallest id, and the k + 1 smallest ids of each are
    put back at the end, which is all that k results can need; so copies do
    not meet in one task. The codes select: of each block of codes a query
    ranks exactly the SHARE with the largest approximate cosines (k + 1 at
    least) and all that look as near as its best ones do, less what the stored
    norms rule out. ``exact`` ranks whatever these leave of all codes, so the
    result is that of comparing every pair exactly.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    schema = f"query_id long, rank int, {id_col} long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == lengths.d)
    valid = rows.select("id", "vector").dropDuplicates(["id", "vector"])
    sample = valid.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).select("vector").collect()
    books = train_codebooks(_unit(np.array([r.vector for r in sample], np.float64)))

    within = Window.partitionBy("vector").orderBy("id")
    firsts = valid.withColumn("n", F.row_number().over(within)).where(F.col("n") <= k + 1)
    firsts = scratch.write(firsts.select("id", "n", "vector", F.min("id").over(Window.partitionBy("vector")).alias("rep")), "vectors")
    distinct = firsts.where("n = 1").select("rep", "vector")
    coded = scratch.write(distinct.mapInArrow(partial(_encoded, books=books), "ids binary, codes binary, norms binary, originals binary"), "codes")
    asked = rows.where("asked").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = scratch.write(asked.mapInArrow(_query_rows, "id long, vector binary"), "queries")

    # A stated query set against all rows, in blocks: each lane is one group of queries and one slice of code blocks.
    blocks, groups = coded.count(), -(-asked.count() // GROUP)
    slices = max(1, -(-blocks // SLICE), min(blocks, -(-2 * spark.sparkContext.defaultParallelism // max(1, groups))))
    lanes = max(1, slices * groups)
    lane = lambda group, part: (group * slices + part).cast("long").alias("lane")
    parts, every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), F.explode(F.sequence(F.lit(0), F.lit(max(0, groups - 1))))
    group_of, slice_of = F.pmod(F.xxhash64("id"), F.lit(max(1, groups))), F.pmod(F.xxhash64("ids"), F.lit(slices))
    questions = asked.withColumn("part", parts).select(lane(group_of, F.col("part")), "id", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "codes", "norms")], F.col("vector").alias("originals"))
    answers = coded.withColumn("group", every).select(lane(F.col("group"), slice_of), F.lit(None).cast("long").alias("id"), "ids", "codes", "norms", "originals")
    dealt = questions.union(answers).repartition(lanes, "lane").sortWithinPartitions("lane", F.col("codes").isNotNull(), "id")
    ranked = scratch.write(dealt.mapInArrow(partial(_scored, books=books, n=k + 1, exact=exact), "query_id long, rep long, score double"), "shortlists")
    order = Window.partitionBy("query_id")
    classes = ranked.withColumn("n", F.row_number().over(order.orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1).drop("n")
    members = classes.join(firsts.select("rep", F.col("id").alias(id_col)), "rep").where(F.col("query_id") != F.col(id_col))
    top = members.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), id_col))).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, "score")
