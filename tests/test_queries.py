"""Every query with SQL against DuckDB on the same tables."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumaframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want and got


def test_bucket_counts_hold_every_row(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_extendedprice", "l_quantity").collect()
    at = [(math.floor(p) % 256 // 4, math.floor(q)) for p, q in items]
    rows = registry.queries()["bucket_counts"](spark, SF).collect()
    assert {(r.bx, r.b_y): r.n for r in rows} == Counter((x // 4, y // 4) for x, y in at) and sum(r.n for r in rows) == len(items) > 500
    assert {(r.mean_x, r.mean_y) for r in rows} == {(sum(x for x, _ in at) / len(at), sum(y for _, y in at) / len(at))}


@pytest.fixture(scope="module")
def near_whole(tmp_path_factory):
    """A folder with vectors of 127ths: half of them times 127 are whole as floats and just below that as doubles."""
    values = (np.arange(-70, 71) / 127).astype(np.float32)
    assert (values.astype(np.float64) * 127 < values * np.float32(127)).sum() == 70
    drawn = np.random.default_rng(1).choice(values, (120, 64))
    path = tmp_path_factory.mktemp("near_whole")
    pq.write_table(pa.table({"vec_id": pa.array(range(120), pa.int64()), "embedding": pa.array(list(drawn), pa.list_(pa.float32())), "label": pa.array([0] * 120, pa.int32())}), path / "embeddings.parquet")
    return path


@pytest.mark.parametrize(
    "name",
    [
        "best_vector",
        "chroma_dc",
        "coding_order",
        "dct4x4",
        "dct8x8",
        "dequant",
        "dequant_8x8",
        "hadamard",
        "hadamard_dc",
        "idct8x8",
        "masked_inverse",
        "satd",
        "split_8x8",
        "zigzag",
    ],
)
def test_products_near_whole_numbers(spark, near_whole, name):
    rows = registry.queries()[name](spark, str(near_whole))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{near_whole}/embeddings.parquet'")
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and want
