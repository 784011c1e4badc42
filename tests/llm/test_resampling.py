"""Importance resampling against a plain computation, document by document, and against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from lumaframe.llm import resampling
from lumaframe.llm.resampling import ngram_buckets, resample, word_ids

SF = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))


def features(text, longest, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets, percent, least):
    s, t = (Counter(b for text in texts for b in features(text, longest, buckets)) for texts in ([d[1] for d in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows, may = [], []
    for i, text in docs:
        found = features(text, longest, buckets)
        weight, score = sum(map(gain, found)), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
            if len(words(text)) >= least:
                may.append((-score, i, len(found), weight, len(rows)))
        rows.append([i, len(found), weight, score, None])
    for rank, (*_, at) in enumerate(sorted(may)[: len(may) * percent // 100], 1):
        rows[at][4] = rank
    return sorted(map(tuple, rows), key=str)


def documents():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "été", "ÉTÉ", "x1", "한국", "a", "b", "İ"] + [f"w{i}" for i in range(40)]
    made = [(i, rng.choice([" ", "  ", "-", "\n", "\x00"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 19, 20, 21, 60])))) for i in range(200)]
    made += [(500 + i, made[7][1]) for i in range(300)]  # a group of copies
    return made + [(7, made[7][1]), (7, made[7][1]), (None, "null id " * 20), (None, None), (900, None), (901, ""), (902, "..."), (903, "long word" + "y" * 300000 + " " + "z w " * 100000)]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10000, 10), (3, 97, 50), (2, 10000, 100), (1, 5, 0)])
def test_resampling_of_odd_rows(spark, longest, buckets, percent):
    docs, target = documents(), ["alpha beta x1", None, "", "été a b", "alpha beta x1"]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, rank int, id string").repartition(7)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    found = resample(frame, aims, longest=longest, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, target, longest, buckets, percent, 20)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert resample(docs, target).count() == 0
    some = [(i, "a b c d " * 5 + str(i)) for i in range(30)]
    found = resample(spark.createDataFrame(some, docs.schema), target)
    assert sorted(map(tuple, found.collect()), key=str) == brute(some, [], 1, 10000, 10, 20)
    with pytest.raises(ValueError):
        resample(docs, target, percent=101)


def test_every_distinct_tuple_is_hashed_once(monkeypatch):
    hashed = []
    monkeypatch.setattr(resampling.zlib, "crc32", lambda raw: hashed.append(raw) or len(raw))
    texts = pa.array(["a b a b a", None, "b a", ""] * 50).slice(1)
    found, owner = ngram_buckets(*word_ids(texts), 3, 100)
    assert sorted(hashed) == sorted({*hashed}) == [b"a", b"a b", b"a b a", b"b", b"b a", b"b a b"]
    assert Counter(owner.tolist())[3] == 5 + 4 + 3 and len(found) == 49 * 12 + 50 * 3


def test_resampling_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = resample(*[spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark")])
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.oracle()})").fetchall()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
