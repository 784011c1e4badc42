"""MinHash near-duplicate grouping with SuperMinHash signatures.

1. One pass over the texts makes, for each document, its number of shingles, a
   128-bit fingerprint of its shingle set and one hash for each band of its
   signature.
2. Documents with equal sets form a class; from here only the class's smallest
   id goes on, so that thousands of copies cost one row.
3. Classes that share a band are candidates. Each bucket's members are held
   against its smallest member by the exact Jaccard similarity of their full
   shingle sets.
4. Union-find over the confirmed links. In a bucket whose members are still in
   several components, links between these are sought too: in small buckets
   pair by pair, save pairs that the triangle inequality of the Jaccard
   distance rules out (both distances to the bucket's smallest member are known
   by then), in large ones block against block, where no pair becomes a row.
   So all links inside buckets are found while members that are already joined
   are never held against each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.components import connected_components
from lumaframe.llm.scratch import Scratch
from lumaframe.llm.shingles import mix, shingle_sets, super_minhash, text_slices
from lumaframe.llm.skew import join_counted, join_salted, maybe_among

#: Registers in a band.
ROWS = 5
#: The number of bands keeps the chance of missing a pair just at the threshold below this.
MISS = 1e-5
#: Buckets of up to so many members have pairs across components verified one by one, larger ones block against block.
PAIRED = 16
#: Sets in a block, about.
BLOCK = 128
#: Stands for the blocks of all small components.
_NONE = -(2**63) + 1


def bands_for(similarity: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))) if similarity < 1 else 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(_signed(np.ascontiguousarray(flat))))


def _signatures(batches: Iterator[pa.RecordBatch], width: int, bands: int) -> Iterator[pa.RecordBatch]:
    odd = mix(np.arange(ROWS, dtype=np.uint64), 50) | np.uint64(1)
    names = ["id", "n_shingles", "set_a", "set_b", "bands"]
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = shingle_sets(part.column("text"), width)
            signatures = super_minhash(sets, bands * ROWS).reshape(len(sets), bands, ROWS)
            keys = mix((signatures * odd).sum(axis=2, dtype=np.uint64) ^ mix(np.arange(bands, dtype=np.uint64), 51), 52)
            a, b = _fingerprints(sets)
            rows = [keys[i] if len(s) else keys[i][:0] for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(a)), pa.array(_signed(b)), _lists(rows)], names=names)


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.array([mix(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64) for salt in (60, 61))
    return a, b


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the rows whose set is the one that is wanted for their id."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            sets = shingle_sets(part.column("text"), width)
            a, b = map(_signed, _fingerprints(sets))
            right = np.flatnonzero((a == part.column("set_a").to_numpy()) & (b == part.column("set_b").to_numpy()))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(right)), _lists([sets[i] for i in right])], names=["id", "shingles"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) -> (a, b, similarity double, linked), by the full sets. A head ``b`` may be in very many pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    pairs = scratch.write(pairs, "pairs")
    merged = join_salted(pairs.join(left.hint("merge"), "a"), right, "b", "a", pairs, pairs.count()).select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("total"), both.alias("common"))
    union = F.col("total") - F.col("common")
    return merged.select("a", "b", (F.col("common") / union).alias("similarity"), (100 * F.col("common") >= percent * union).alias("linked"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of anything but ASCII white space, with A-Z lowered; a
    shingle is ``width`` words, or the whole text where it has fewer. Returns
    one row for each row of ``docs``: id_col (long), n_shingles, component_id
    (smallest id reachable) and kept (the id is its component's smallest).

    Texts that are null or without words have no shingles, link with nothing
    and are kept. A row without id cannot be named by a component: it comes
    back with a null component_id and is kept. Rows that repeat an id with the
    same text get the same result, each. Rows that repeat an id with different
    texts are grouped each by its own text; where such an id is the smallest of
    several sets, its set of the smallest fingerprint is the one that is
    verified for all of them. Other columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bands = bands_for(percent / 100)
    signed = scratch.write(source.mapInArrow(partial(_signatures, width=width, bands=bands), "id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")

    named = signed.where("id is not null and n_shingles > 0")
    classes = named.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")
    buckets = classes.select("rep", "set_a", "set_b", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("head")).where("members > 1")
    shared = scratch.write(shared, "shared")
    members = scratch.write(join_counted(buckets, shared, ["bucket"], "members", bands * classes.count()).drop("members"), "members")

    wanted = members.groupBy(F.col("rep").alias("id")).agg(F.min(F.struct("set_a", "set_b")).alias("set")).select("id", "set.*")
    wanted = scratch.write(wanted, "wanted")
    # Only texts that may be wanted travel. Joins of two sides that grow with the corpus are merge joins at every size.
    texts = maybe_among(source.where("id is not null"), wanted, "id").join(wanted.hint("merge"), "id")
    sets = scratch.write(texts.mapInArrow(partial(_sets, width=width), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")

    to_head = members.where("rep != head").select(F.col("rep").alias("a"), F.col("head").alias("b")).distinct()
    tested = scratch.write(_verify(to_head, sets, percent, scratch), "tested")
    links = tested.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    grouped = connected_components(links, scratch)

    state = scratch.write(members.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "state")
    sizes = state.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket", "size")
    mixed = scratch.write(join_counted(state, sizes, ["bucket"], "size", state.count()), "mixed")
    few = _verify(_crossing(mixed.where(F.col("size") <= PAIRED), tested, percent), sets, percent, scratch).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = scratch.write(few.union(_crossing_blocks(mixed.where(F.col("size") > PAIRED), sets, percent, scratch)), "links")
    if not more.isEmpty():
        stars = grouped.select(F.col("node").alias("u"), F.col("component").alias("v"))
        grouped = connected_components(stars.union(more), scratch)

    labelled = classes.join(grouped.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "copies", F.coalesce("component", "rep").alias("component_id"))
    rest = signed.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    found = join_counted(named, labelled, ["set_a", "set_b"], "copies", named.count()).select("id", "n_shingles", "component_id").union(rest)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _crossing(mixed: DataFrame, tested: DataFrame, percent: int) -> DataFrame:
    """Pairs of one small bucket in different components, not tested yet and not ruled out by their distances to its head."""
    known = mixed.join(tested.select(F.col("a").alias("rep"), F.col("b").alias("head"), (1 - F.col("similarity")).alias("away")), ["rep", "head"])
    other = known.select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("away").alias("away_b"), F.col("component").alias("cb"))
    near = (F.col("rep") < F.col("b")) & (F.col("component") != F.col("cb")) & (F.abs(F.col("away") - F.col("away_b")) <= 1 - percent / 100 + 1e-9)
    size = 100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")
    return known.join(other, "bucket").where(near & size).select(F.col("rep").alias("a"), "b").distinct()


def _between(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Two blocks of sets a row: one link for each two components that have any between the blocks."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids, comps, sets = [], [], []
            for side in ("x", "y"):
                block = batch.column(side)[row].values
                ids.append(block.field("rep").to_numpy())
                comps.append(block.field("component").to_numpy())
                sets.append([s.values.to_numpy().view(np.uint64) for s in block.field("shingles")])
            lengths = [np.array([len(s) for s in side]) for side in sets]
            flat = [np.concatenate(side) for side in sets]
            owner = [np.repeat(np.arange(len(n)), n) for n in lengths]
            shared = np.intersect1d(flat[0], flat[1])
            both = np.zeros((len(ids[0]), len(ids[1])), np.float32)
            at = [np.searchsorted(shared, f) for f in flat]
            hit = [np.append(shared, 0)[a] == f if len(shared) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
            for lo in range(0, len(shared), 4096):
                grids = []
                for side in (0, 1):
                    here = hit[side] & (at[side] >= lo) & (at[side] < lo + 4096)
                    grid = np.zeros((len(ids[side]), min(4096, len(shared) - lo)), np.float32)
                    grid[owner[side][here], at[side][here] - lo] = 1
                    grids.append(grid)
                both += grids[0] @ grids[1].T
            union = lengths[0][:, None] + lengths[1] - both
            linked = (100 * both >= percent * union) & (comps[0][:, None] != comps[1])
            found = {(comps[0][i], comps[1][j]): (ids[0][i], ids[1][j]) for i, j in zip(*np.nonzero(linked), strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array([int(u) for u, _ in found.values()], pa.int64()), pa.array([int(v) for _, v in found.values()], pa.int64())], names=["u", "v"])


def _crossing_blocks(mixed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between components that meet in large buckets, found block against block; no pair becomes a row.

    Large buckets that share members are one family. Its members are dealt
    into blocks, a large component into blocks of its own, and two blocks meet
    unless they are of the same component. All links are found that the
    buckets hold, and at most one for two blocks and two components comes out.
    """
    family = connected_components(mixed.select(F.col("rep").alias("u"), F.col("head").alias("v")).distinct(), scratch)
    reps = mixed.select(F.col("rep").alias("node"), "component").distinct().join(family.withColumnRenamed("component", "family"), "node")
    large = reps.groupBy("family", "component").agg(F.count("*").alias("m")).where(F.col("m") >= BLOCK).withColumn("whole", F.col("component"))
    reps = reps.join(large, ["family", "component"], "left")
    others = reps.where("whole is null").groupBy("family").agg(F.count("*").alias("rest"))
    reps = reps.join(others, "family", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.coalesce("m", "rest") / BLOCK)).cast("long"))
    reps = scratch.write(reps.withColumn("whole", F.coalesce("whole", F.lit(_NONE))).select("family", "whole", "part", "node", "component"), "families")
    filled = reps.join(sets.withColumnRenamed("id", "node"), "node").groupBy("family", "whole", "part").agg(F.collect_list(F.struct(F.col("node").alias("rep"), "component", "shingles")).alias("block"))
    filled = scratch.write(filled, "blocks")
    keys = filled.select("family", "whole", "part")
    left, right = keys.toDF("family", "wx", "px"), keys.toDF("family", "wy", "py")
    meet = left.join(right, "family").where(f"(wx != wy or wx = {_NONE}) and (wx < wy or (wx = wy and px <= py))")
    x, y = filled.toDF("family", "wx", "px", "x"), filled.toDF("family", "wy", "py", "y")
    meet = meet.join(x, ["family", "wx", "px"]).join(y, ["family", "wy", "py"]).select("x", "y")
    return meet.mapInArrow(partial(_between, percent=percent), "u long, v long")
