"""Held reference pictures under memory operations, and reference lists with edits.

Which references a picture holds depends on the operations of all pictures
since the last IDR picture, so it is a fold in decode order; periods are dealt
over tasks, sorted, and streamed through, with no more than the held
references in memory. Lists are made of these in the row, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumaframe.operators.sequence import assign_gop

_REFS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("ref", "frame_num", "poc", "lsb")]))


def _retire(held: list[dict], ops: list[dict] | None, frame_num: int, max_frame_num: int) -> list[dict]:
    """What is left after a picture's memory operations; 1 and 5 act, as they do on short-term references of frames."""
    for op in ops or []:
        if op["op"] == 5:
            held = []
        elif op["op"] == 1:
            named = [h for h in held if h["frame_num"] == (frame_num - op["a"] - 1) % max_frame_num]
            if named:
                gone = max(named, key=lambda h: h["poc"])  # the first of the largest
                held = [h for h in held if h is not gone]
    return held


def _fold(batches: Iterator[pa.RecordBatch], stream: str, index: str, refs: pa.Field) -> Iterator[pa.RecordBatch]:
    period, held = None, []
    for batch in batches:
        column = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
        out = []
        for s, gop, i, is_ref, n, poc, lsb, ops, size, most in zip(*map(column, (stream, "gop", index, "_ref", "_frame_num", "_poc", "_lsb", "_ops", "_size", "_max")), strict=True):
            if (s, gop) != period:
                period, held = (s, gop), []
            out.append(list(held))
            if is_ref:
                held = [*_retire(held, ops, n, most), {"ref": i, "frame_num": n, "poc": poc, "lsb": lsb}][-size:]
        kept = [c for c in batch.schema.names if not c.startswith("_") and c != "gop"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, refs.type)], names=[*kept, "refs"])


def hold_references(pictures: DataFrame, stream: str, index: str, is_idr: Column, is_reference: Column, frame_num: Column, poc: Column, ops: Column, max_frame_num: Column | int, size: Column | int, lsb: Column | None = None) -> DataFrame:
    """refs: the references held before each picture is decoded, in decode order: array of (ref, frame_num, poc, lsb).

    ``poc`` is the full picture order, ``lsb`` its low part (the full one
    unless given). ``ops`` are a picture's memory operations (op, a, ...): 1
    retires the reference whose frame number lies a + 1 before the picture's,
    wrapped by ``max_frame_num``; of several the one of the largest picture
    order, of equal ones the first. 5 retires all. Others do nothing. They act
    after the picture is decoded and before it is held itself; a reference
    above ``size`` pushes the oldest out. An IDR picture holds nothing of what
    was before it. Operations of pictures that are no references are ignored.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    step = assign_gop(pictures, stream, index, is_idr)
    step = step.select(
        *pictures.columns, "gop", F.coalesce(is_reference, F.lit(False)).alias("_ref"), frame_num.cast("long").alias("_frame_num"), poc.cast("long").alias("_poc"),
        (poc if lsb is None else lsb).cast("long").alias("_lsb"), F.transform(ops, lambda o: F.struct(o["op"].cast("int").alias("op"), o["a"].cast("long").alias("a"))).alias("_ops"),
        lit(size).cast("int").alias("_size"), lit(max_frame_num).cast("long").alias("_max"),
    )
    schema = T.StructType([*[pictures.schema[c] for c in pictures.columns], T.StructField("refs", _REFS)])
    refs = to_arrow_schema(schema).field("refs")
    # Sorted partitions are streamed: a period may be as long as it likes.
    return step.repartition(stream, "gop").sortWithinPartitions(stream, "gop", index).mapInArrow(lambda batches: _fold(batches, stream, index, refs), schema)


def _sorted(refs: Column, *falling_then_rising: tuple[str, int]) -> Column:
    """``refs`` by several fields, each falling (-1) or rising (1); fields of a struct sort in order."""
    keyed = F.transform(refs, lambda r: F.struct(*[(sign * r[name]).alias(f"k{n}") for n, (name, sign) in enumerate(falling_then_rising)], r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda k: k["r"])


def first_list_p(refs: Column) -> Column:
    """Highest frame number first, then the highest low part of the picture order; latest first where all have one frame number."""
    one = F.array_min(F.transform(refs, lambda r: r["frame_num"])) == F.array_max(F.transform(refs, lambda r: r["frame_num"]))
    return F.when(one, F.reverse(refs)).otherwise(_sorted(refs, ("frame_num", -1), ("lsb", -1), ("ref", -1)))


def first_lists_b(refs: Column, poc: Column) -> tuple[Column, Column]:
    """List 0: those before ``poc``, nearest first. List 1: those after it, nearest first, then all others from the latest down; of equal orders the highest frame number."""
    zero = _sorted(F.filter(refs, lambda r: r["poc"] < poc), ("poc", -1), ("ref", 1))
    after = _sorted(F.filter(refs, lambda r: r["poc"] > poc), ("poc", 1), ("frame_num", -1), ("ref", 1))
    others = _sorted(F.filter(refs, lambda r: r["poc"] <= poc), ("poc", -1), ("frame_num", -1), ("ref", 1))
    return zero, F.concat(after, others)


def edit_list(refs: Column, edits: Column, frame_num: Column, max_pic_num: int = 16, b_slice: bool = False) -> Column:
    """``refs`` after list edits (op, value), as a fold over them in the row.

    Op 0 steps the wanted picture number back by value + 1, op 1 forward, both
    wrapped by ``max_pic_num``, from ``frame_num`` on; other ops only take a
    place. The first entry of that number moves to the edit's own place and
    the ones between go back by one. A picture that is not in the list changes
    nothing. In P lists an entry that already stands before its place is
    repeated there, and one for a place past the end is added at the end; in
    B lists both are left out, the latter without a step.
    """
    numbered = F.transform(edits, lambda e, i: F.struct(e["op"].cast("int").alias("op"), e["value"].cast("long").alias("value"), i.alias("i")))
    start = F.struct(refs.alias("refs"), F.pmod(frame_num.cast("long"), F.lit(max_pic_num).cast("long")).alias("number"))

    def step(state: Column, e: Column) -> Column:
        held, i = state["refs"], e["i"]
        acts = e["op"].isin(0, 1) & (i < F.size(held) if b_slice else F.lit(True))
        away = F.when(e["op"] == 0, -1).otherwise(1) * (e["value"] + 1)
        number = F.when(acts, F.pmod(state["number"] + away, F.lit(max_pic_num).cast("long"))).otherwise(state["number"])
        at = F.array_position(F.transform(held, lambda r: r["frame_num"]), number).cast("int")  # from 1; 0: not there
        entry = F.slice(held, F.greatest(at, F.lit(1)), 1)
        head = F.slice(held, 1, F.least(i, F.size(held)))
        later = F.concat(head, entry, F.slice(held, i + 1, F.greatest(at - 1 - i, F.lit(0))), F.slice(held, at + 1, F.size(held)))
        if b_slice:
            moved = F.when(~acts | (at - 1 < i), held).otherwise(later)
        else:
            again = F.concat(head, entry, F.slice(held, i + 1, F.size(held)))
            moved = F.when(~acts | (at == 0), held).when((i >= F.size(held)) | (at - 1 < i), again).otherwise(later)
        return F.struct(moved.alias("refs"), number.alias("number"))

    return F.aggregate(numbered, start, step, lambda state: state["refs"])
