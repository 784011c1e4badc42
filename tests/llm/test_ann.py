"""How much the codes select, and what the selection loses."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumaframe.llm import ann

K = 5


def selected(x, exact=False):
    """(recall of the K nearest others, part of all pairs that is multiplied exactly), rows in random order and blocks."""
    x = np.unique(x.astype(np.float32), axis=0)
    rng = np.random.default_rng(1)
    x = x[rng.permutation(len(x))]
    books = ann.train_codebooks(ann._unit(x[rng.permutation(len(x))[: ann.SAMPLE]]))
    codes = ann.encode(ann._unit(x), books)
    norms = ann.stored_norms(ann._unit(x), codes, books)
    asked = np.arange(0, len(x), max(50, len(x) // 400))
    group = ann._Group(list(asked), [x[i].tobytes() for i in asked], books, K + 1, exact)
    for at in range(0, len(x), ann.CODE_BLOCK):
        part = slice(at, at + ann.CODE_BLOCK)
        group.see(np.arange(len(x))[part], codes[part].astype(np.uint8), norms[part].T, x[part].astype(np.float64))
    unit = ann._double_unit(x)
    found = 0
    for n, i in enumerate(asked):
        close = unit @ unit[i]
        close[i] = -np.inf
        found += len({*np.argsort(-close)[:K]} & ({*group.known[n]} - {i}))
    return found / (K * len(asked)), group.multiplied / (len(asked) * len(x))


def given():
    return np.stack(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist())


def test_selection_on_the_given_vectors():
    recall, part = selected(given())
    print(recall, part)
    assert recall >= 0.95 and part <= 0.05


def test_selection_on_gaussian_vectors():
    recall, part = selected(np.random.default_rng(3).standard_normal((20_000, 64)))
    print(recall, part)
    assert recall >= 0.95 and part <= 0.05


def test_selection_on_clustered_vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((2000, 32))
    recall, part = selected(centres[rng.integers(0, 2000, 100_000)] + 0.2 * rng.standard_normal((100_000, 32)))
    print(recall, part)
    assert recall >= 0.95 and part <= 0.01


def test_groups_of_changed_copies_are_ranked_whole():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 16))
    x[2000:] = x[0] + 0.001 * rng.standard_normal((4000, 16))
    assert selected(x)[0] >= 0.99


def test_stored_norms_bound_the_score():
    rng = np.random.default_rng(6)
    x = ann._unit(rng.standard_normal((500, 12)))
    books = ann.train_codebooks(x, books=3, words=16)
    codes = ann.encode(x, books)
    length, scale, rest = ann.stored_norms(x, codes, books).T
    made = sum(books[i][codes[:, i]] for i in range(3))
    near = x @ made.T / length
    assert (np.abs(x @ x.T - near * length * scale) <= np.sqrt(np.maximum(0, 1 - near**2)) * rest + 1e-4).all()


@pytest.mark.parametrize("sizes", [(1, 1), (64, 7)])
def test_exact_search_is_brute_force(spark, monkeypatch, sizes):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:900] = x[3] * rng.uniform(0.5, 2, (200, 1)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    monkeypatch.setattr(ann, "CODE_BLOCK", 16 * sizes[0])
    monkeypatch.setattr(ann, "QUERIES", sizes[1])
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, exact=True).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = ann._double_unit(x)
    assert sorted(got) == list(range(0, 1500, 50))
    for q, found in got.items():  # by score, since rescaled copies differ by rounding alone
        close = unit @ unit[q]
        assert [s for _, s in found] == pytest.approx([close[i] for i, _ in found], abs=1e-12)
        close[q] = -np.inf
        assert [s for _, s in found] == pytest.approx(np.sort(close)[::-1][:5].tolist(), abs=1e-12) and len({i for i, _ in found} - {q}) == 5
