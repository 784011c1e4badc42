"""The filter audit against a run of every chain, document by document, and against SQL."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumaframe.llm import filter_audit
from lumaframe.llm.filter_audit import adjacent_swaps, audit, audit_corpus, walk

SF = "/root/testdata/sf0.001"


def test_swaps_visit_every_order_once():
    for k in range(1, 7):
        order, seen = list(range(k)), [tuple(range(k))]
        for at in adjacent_swaps(k):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.append(tuple(order))
        assert len(seen) == len({*seen}) == math.factorial(k)


def test_only_two_steps_change_between_orders():
    cells = np.random.default_rng(2).integers(0, 50, (3, 16, 2))
    last = None
    for order, kept, removed, _ in walk(cells, 4):
        if last:
            changed = [i for i in range(4) if last[0][i] != order[i]]
            assert changed == [changed[0], changed[0] + 1]
            rest = [i for i in range(4) if i not in changed]
            assert (kept[:, rest] == last[1][:, rest]).all() and (removed[:, rest] == last[2][:, rest]).all()
        last = list(order), kept.copy(), removed.copy()


def brute(docs, labels):
    """docs: (doc_id, text, lang)."""
    good, toxic = ({d for d, *v in labels if d is not None and v[n] == 1} for n in (0, 1))
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len({*words}) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and d > smallest[t],
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, d in good and d is not None, d in toxic and d is not None))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            everyone = left
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in everyone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in everyone), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shares[part, f] += len(gone)
    return {(p, o, s, *v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def odd_documents():
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice(["aa", "Bb", "CC", f"w{rng.random()}", "#"]) for _ in range(rng.choice([0, 3, 99, 100, 140]))), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    made += [(100 + i, made[3][1], "en") for i in range(50)]  # a group of copies
    made += [(3, made[3][1], "fr"), (3, made[3][1], "fr"), (3, "other", "en")]  # rows that repeat an id
    made += [(None, made[3][1], "en"), (None, None, None), (201, None, "en"), (202, "", "en"), (203, " ", "en"), (204, "x " * 40000, "de")]
    return made


def test_audit_of_odd_rows(spark):
    docs = odd_documents()
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 150, 3)] + [(0, 0, 1), (6, None, None), (None, 1, 1), (999, 1, 1), (9, 1, None), (9, None, 1)]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, lang string, quality int, part string").repartition(5)
    found = audit_corpus(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert found.columns == COLUMNS
    assert {tuple(r) for r in found.collect()} == brute(docs, labels)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_corpus(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert {tuple(r) for r in audit_corpus(one, labels).collect()} == brute([(1, None, None)], [])


def test_audit_adds_up_cells_of_one_mask_and_refuses_odd_chains(spark):
    cells = spark.createDataFrame([("p", 1, 2, 1), ("p", 1, 3, 0), ("p", 0, 7, 7), ("q", 3, 1, 1)], "part string, mask int, n long, lost long")
    got = defaultdict(dict)
    for r in audit(cells, ["X", "Y"], ["lost"]).collect():
        got[r.part, r.filter_order][r.step] = (r.kept, r.removed, r.redundant, r.unique_fails, r.lost, r.shapley)
    assert got["p", "XY"] == {1: (7, 5, 0, 5, 1, 10), 2: (7, 0, 0, 0, 0, 0)}
    assert got["q", "YX"] == {1: (0, 1, 0, 0, 1, 1), 2: (0, 0, 1, 0, 0, 1)}
    for wrong in ([], ["A", "A"], ["AB"], list("ABCDEFGHI")):
        with pytest.raises(ValueError):
            audit(cells, wrong, ["lost"])


def test_audit_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = audit_corpus(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")])
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.oracle()})").fetchall()
    assert {tuple(r) for r in found.collect()} == {*want}
