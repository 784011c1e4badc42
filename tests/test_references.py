"""Held references and edited lists against a plain decoder-like loop on random pictures."""

import random

from pyspark.sql import functions as F

from lumaframe.operators import references

SCHEMA = "s string, i long, idr boolean, ref boolean, n long, p long, ops array<struct<op:int,a:long,b:long>>, edits array<struct<list:int,op:int,value:long>>"


def pictures(seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for i in range(150):
            ops = rng.choice([None, [], [], *[[(rng.choice([1, 1, 1, 2, 5, 6]), rng.randrange(9), 0) for _ in range(rng.randrange(1, 4))] for _ in range(4)]])
            edits = [(0, rng.choice([0, 1, 2]), rng.randrange(20)) for _ in range(rng.randrange(5))]
            rows.append((s, 3 * i, rng.choice([True, None, *[False] * 12]), rng.choice([True, True, True, False, None]), rng.randrange(8), rng.randrange(-6, 6), ops, edits))
    rng.shuffle(rows)
    return rows


def plainly(rows, size, modulus):
    out = {}
    for s in {r[0] for r in rows}:
        held = []
        for _, i, idr, ref, n, p, ops, edits in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if idr:
                held = []
            one = len({h[1] for h in held}) < 2
            listed = held[::-1] if one else sorted(held, key=lambda h: (-h[1], -h[2], -h[0]))
            before = sorted((h for h in held if h[2] < p), key=lambda h: (-h[2], h[0]))
            out[s, i] = [h[0] for h in held], edited(listed, edits, n, modulus, False), edited(before, edits, n, modulus, True)
            if ref:
                for op, a, _ in ops or []:
                    if op == 5:
                        held = []
                    if op == 1:
                        at = None
                        for k, h in enumerate(held):
                            if h[1] == (n - a - 1) % modulus and (at is None or h[2] > held[at][2]):
                                at = k
                        if at is not None:
                            del held[at]
                held = [*held, (i, n, p)]
                if len(held) > size:
                    del held[0]
    return out


def edited(listed, edits, number, modulus, b_slice):
    listed = list(listed)
    number %= modulus
    for place, (_, op, value) in enumerate(edits):
        if op > 1 or b_slice and place >= len(listed):
            continue
        number = (number + (value + 1) * (-1 if op == 0 else 1)) % modulus
        at = next((k for k, h in enumerate(listed) if h[1] == number), None)
        if at is None or b_slice and at < place:
            continue
        if at >= place:
            listed.insert(place, listed.pop(at))
        else:
            listed.insert(place, listed[at])
    return [h[0] for h in listed]


def test_held_references_and_edited_lists(spark):
    rows = pictures(5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    held = references.hold_references(frame, "s", "i", F.col("idr"), F.col("ref"), F.col("n"), F.col("p"), F.col("ops"), 8, 4)
    assert held.columns == [*frame.columns, "refs"]
    names = lambda refs: F.transform(refs, lambda r: r["ref"])
    listed = references.edit_list(references.first_list_p(F.col("refs")), F.col("edits"), F.col("n"), 8)
    zero = references.edit_list(references.first_lists_b(F.col("refs"), F.col("p"))[0], F.col("edits"), F.col("n"), 8, b_slice=True)
    got = {(r.s, r.i): (r.held, r.l, r.b) for r in held.select("s", "i", names("refs").alias("held"), names(listed).alias("l"), names(zero).alias("b")).collect()}
    want = plainly(rows, 4, 8)
    assert got == want
    assert any(len(l) > len(h) for h, l, _ in want.values())  # an entry stood before its place


def test_a_period_of_many_pictures_is_streamed(spark):
    n = 30_000  # several Arrow batches of one period in one task
    frame = spark.range(n).select(F.lit("x").alias("s"), F.col("id").alias("i"), (F.col("id") == 0).alias("idr"), F.lit(True).alias("ref"), (F.col("id") % 16).alias("n"), F.col("id").alias("p"), F.expr("CAST(NULL AS array<struct<op:int,a:long>>)").alias("ops"))
    held = references.hold_references(frame, "s", "i", F.col("idr"), F.col("ref"), F.col("n"), F.col("p"), F.col("ops"), 16, 3)
    wrong = held.where(F.transform("refs", lambda r: r["ref"]) != F.filter(F.array(F.col("i") - 3, F.col("i") - 2, F.col("i") - 1), lambda x: x >= 0))
    assert held.count() == n and wrong.count() == 0
    assert references.hold_references(frame.limit(0), "s", "i", F.col("idr"), F.col("ref"), F.col("n"), F.col("p"), F.col("ops"), 16, 3).count() == 0
