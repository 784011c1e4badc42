"""Nearest vectors, packing, mixing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumaframe.llm.ann import nearest
from lumaframe.llm.mixing import mix_sources, pfair_period, schedule, whole_weights
from lumaframe.llm.packing import pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for n, q in enumerate(ids):
        if q % 50 == 0:
            order = np.lexsort((ids, -np.round(x @ x[n], 12)))
            out[int(q)] = [int(ids[j]) for j in order if ids[j] != q][:k]
    return out


def test_nearest_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], 5)
    got = defaultdict(list)
    for r in nearest(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sum(len({*got[q]} & {*v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nearest_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 400)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8), (550, [None] * 8), (None, rows[0][1]), (600, [float("inf")] * 8)]
    out = nearest(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute_nearest([r for r in rows if r[0] is not None], 5)
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    assert len(nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_nearest_in_a_group_of_changed_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16))
    x[1000:] = (x[0] + 0.001 * rng.standard_normal((2000, 16))) * rng.uniform(0.5, 2, (2000, 1))
    rows = [(i, [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x[rng.permutation(3000)])]
    got = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute_nearest(rows, 5)


def test_packing_round_trip(spark):
    rng = random.Random(9)
    texts = [None, "", "a", "<|endoftext|> x", "Σ é 한 1.5, it's."] + [" ".join(rng.choice(["alpha", "Beta.", "été,", "12", "##"]) for _ in range(rng.choice([3, 40, 700, 3000]))) for _ in range(80)]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "null id", "c")], "doc_id long, text string, ids string").repartition(6)
    rows = pack_documents(frame, PATH, size=512, open_windows=4).collect()
    library = Tokenizer.from_file(PATH)
    got, places = defaultdict(dict), defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0 and zlib.crc32(r.ids) >= 0
        got[r.doc_id][r.start] = (ids, r.doc_tokens)
        places[r.sequence_id][r.offset] = r.length
    for i, t in [*enumerate(texts), (None, "null id")]:
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        joined = [x for s in sorted(got[i]) for x in got[i][s][0].tolist()]
        assert joined == want and all(n == len(want) for _, n in got[i].values())
        assert all(s == sum(len(got[i][b][0]) for b in got[i] if b < s) for s in got[i])
    lengths = []
    for pieces in places.values():
        end = 0
        for offset in sorted(pieces):
            assert offset == end
            end += pieces[offset]
        lengths.append(end)
    assert max(lengths) <= 512 and sum(n < 512 for n in lengths) <= 1
    assert pack_documents(frame.where("false"), PATH).count() == 0


def test_pfair_deviation():
    rng = random.Random(1)
    for _ in range(60):
        weights = whole_weights({f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randint(1, 25))}, rng.choice([100, 1000]))
        period, held = sum(weights.values()), Counter()
        for n, (source, release, due, slot) in enumerate(pfair_period(weights), 1):
            held[source] += 1
            assert release <= slot < due
            assert all(abs(held[s] * period - n * w) < period for s, w in weights.items())


def test_schedule_places_every_block_once():
    blocks = {"a": 5000, "b": 37, "c": 1, "d": 1200}
    stretches, slots, end = schedule(blocks, {"a": 0.2, "b": 0.3, "c": 0.1, "d": 0.4})
    at = defaultdict(list)
    for n, s, i, slot, *_ in slots:
        at[n, s].append((i, slot))
    used = sorted(start + turn * period + slot for n, s, first, stop, each, start, period in stretches for turn in range((stop - first) // each) for _, slot in at[n, s])
    assert used == list(range(sum(blocks.values()))) and end == len(used)


def test_schedule_when_whole_periods_use_up_a_source():
    blocks = {"null": 1} | {f"s{i}": 625 for i in range(20)}
    counts = {"null": 1} | {f"s{i}": 10000 for i in range(20)}
    for part in (blocks, {"a": 1000, "b": 1000}):
        stretches, slots, end = schedule(part, {s: counts.get(s, 1) ** 0.5 for s in part})
        at = defaultdict(list)
        for n, s, i, slot, *_ in slots:
            at[n, s].append((i, slot))
        placed = {(s, first + turn * each + i): start + turn * period + slot for n, s, first, stop, each, start, period in stretches for turn in range((stop - first) // each) for i, slot in at[n, s]}
        assert set(placed) == {(s, b) for s, n in part.items() for b in range(n)}
        assert sorted(placed.values()) == list(range(end))
        order, held, lasting = sorted((x, s) for (s, _), x in placed.items()), Counter(), [s for s in part if s.startswith("s")]
        for n, (_, source) in enumerate(order, 1):
            held[source] += 1
            assert all(abs(held[s] * len(lasting) - sum(held[x] for x in lasting)) < 2 * len(lasting) for s in lasting)


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(3000)] + [(None, None), (7, "big"), (7, "big"), (8, "rare")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, source string, mix_slot string")
    out = mix_sources(frame, {"small": 0.25, "big": 0.75}, block_rows=10).orderBy("mix_position").collect()
    assert len(out) == len(rows) and len({r.mix_position for r in out}) == len(rows)
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows)
    assert {r.source for r in out[-2:]} == {None, "rare"}
    slots = sorted({(r.mix_slot, r.source) for r in out})
    small = 0
    for n, (slot, source) in enumerate(slots[:260], 1):
        small += source == "small"
        assert slot == n - 1 and abs(small - 0.25 * n) < 1.2  # weights are rounded to thousandths
    assert mix_sources(frame.where("false")).count() == 0
    assert mix_sources(frame).count() == len(rows)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        made = stage(spark, docs, sf)
        assert made.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(made.collect(), docs.schema)
        held[name] = (before, docs.count())
    assert held["mixing"][0] == held["mixing"][1] and held["line_dedup"][0] == held["line_dedup"][1]
    assert 0 < held["near_dedup"][1] < held["near_dedup"][0]
    library = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_pipeline_sequences_follow_the_mixed_order(spark):
    sf = "/root/testdata/sf0.01"
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    left = {r.doc_id for r in pieces}
    place = {r.doc_id: r.mix_position for r in mix_sources(spark.createDataFrame([r for r in docs if r.doc_id in left])).collect()}
    first = sorted((r.sequence_id, place[r.doc_id]) for r in pieces if r.offset == 0)
    packed_once = [at for sequence, at in first if sequence < 1 << 58]
    assert len(packed_once) > 100 and packed_once == sorted(packed_once)
    ends = {r.sequence_id >> 32 for r in pieces if r.sequence_id < 1 << 58}
    assert len(ends) > 1
