"""Odd rows and brute force that the other tests leave out."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_groups, brute_lines
from test_tables import brute_nearest
from test_text import brute_statistics
from tokenizers import Tokenizer

import corpus_pipeline
from lumaframe.llm.ann import nearest
from lumaframe.llm.components import connected_components
from lumaframe.llm.line_dedup import dedup_lines
from lumaframe.llm.mixing import in_written_order, mix_sources, schedule, whole_weights
from lumaframe.llm.near_dedup import near_duplicates
from lumaframe.llm.packing import pack_documents
from lumaframe.llm.quality_rules import STATISTICS, fit_rules, judge_quality
from lumaframe.llm.quotes import link_quotes
from lumaframe.llm.scratch import Scratch
from lumaframe.llm.shingles import shingle_sets, word_hashes
from lumaframe.llm.skew import join_counted, join_salted, maybe_among

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_words_are_told_apart():
    import pyarrow as pa

    for n in (128, 256, 384):
        a, b = "a" * n, "b" * n
        hashes, _ = word_hashes(pa.array([a + b, b + a, a + b + a, b + a + a]))
        assert len(set(hashes.tolist())) == 4
    assert len({s.tobytes() for s in shingle_sets(pa.array(["x " + "a" * 128 + "b" * 128, "x " + "b" * 128 + "a" * 128]), 3)}) == 2


def test_released_tables_are_only_the_owner_s(spark):
    frame = spark.createDataFrame([(i, f"one two three four five six {i // 2}") for i in range(40)], "doc_id long, text string")
    held = near_duplicates(frame)
    with Scratch(spark) as scratch:
        assert near_duplicates(frame, scratch=scratch).count() == 40
    assert held.count() == 40 and held.where("kept").count() == 20


@pytest.mark.parametrize("size", [15, 16, 17, 300])
def test_buckets_of_every_size(spark, size):
    rng = random.Random(size)
    docs, base = [], [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(size):
        words = list(base)
        for _ in range(rng.choice([0, 3, 6, 9])):
            words[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(docs, 3, 85)


def test_one_id_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "something else altogether here"), (2, text), (3, text + " more"), (4, "something else altogether here")]
    runs = [sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows[::k], "doc_id long, text string"), width=3, percent=85).collect()) for k in (1, -1)]
    assert runs[0] == runs[1] and {c for d, _, c in runs[0] if d == 2} == {1} and len(runs[0]) == 5


def test_skewed_joins(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    counted = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = sorted(map(tuple, rows.join(counted, "k").select("k", "id", "top").collect()))
    assert sorted(map(tuple, join_counted(rows, counted, ["k"], "n", 3000, parts=10).select("k", "id", "top").collect())) == want
    assert sorted(map(tuple, join_salted(rows, counted.drop("n"), "k", "id", rows, 3000, parts=10).select("k", "id", "top").collect())) == want
    few = spark.range(0, 3000, 100)
    kept = {r.id for r in maybe_among(spark.range(3000), few, "id", words=64).collect()}
    assert set(range(0, 3000, 100)) <= kept and len(kept) < 600
    star = spark.range(1, 2000).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    assert {r.component for r in connected_components(star.union(spark.createDataFrame([(5000, 1999)], "u long, v long"))).collect()} == {0}


def test_line_dedup_of_very_long_texts(spark):
    text = "\n".join(f"line {i}" for i in range(60_000))
    rows = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(1, text), (2, "x\n" + text + "\ny")], "doc_id long, text string")).collect()}
    assert rows[1].text == text and rows[2].text == "x\ny" and rows[2].n_removed == 60_000


def test_quality_odd_rows(spark):
    good, bad = "the quick brown fox jumps over the lazy dog and then sleeps under a tall green tree until the sun comes up " * 1, "BUY $$$ NOW !!! " * 1 + " ".join(f"$W{i}!" for i in range(40))
    docs = [(i, good.replace("fox", f"fox{i}") if i % 2 else bad.replace("NOW", f"N{i}")) for i in range(80)] + [(None, good), (3, good), (3, good), (90, None), (91, "")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, kept int")
    labels = [(i, i % 2) for i in range(80)] + [(5, 0), (None, 1), (7, None)]
    rules = fit_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and str(rules) == str(fit_rules(frame.orderBy(F.desc("doc_id")), spark.createDataFrame(labels[::-1], "doc_id long, quality int")))
    out = judge_quality(frame, rules).collect()
    assert len(out) == len(docs)
    for r in out:
        assert tuple(r[c] for c in STATISTICS[:5]) == brute_statistics(r.text)
        assert r.kept == (bool(r.text) and r.text.startswith("the"))
    assert judge_quality(frame.where("false"), rules).count() == 0 and fit_rules(frame.where("false"), spark.createDataFrame(labels, "doc_id long, quality int")) == []
    plan = judge_quality(frame, rules).where("doc_id = 3").select("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Generate")[-1]  # filters on other columns go below the statistics


def test_nearest_of_odd_ids_and_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)]) for i in range(120)]
    odd = [(50, None), (3, None), (200, [1.0, 2.0]), (150, [1.0] * 9), (7, rows[9][1]), (100, rows[100][1])]
    odd += [(1000 + i, [2.0 * x for x in rows[11][1]]) for i in range(4)]  # ties between scaled copies
    out = nearest(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    want = brute_nearest([*rows, *[r for r in odd if r[0] >= 1000]], 5)
    assert set(got) == {0, 50, 100, 1000}
    assert {q: v for q, v in got.items() if 7 not in v} == {q: v for q, v in want.items() if 7 not in got[q]}


@pytest.mark.parametrize("count", [400, 5000])
def test_nearest_in_clusters(spark, count):
    rng = np.random.default_rng(count)
    centres = rng.standard_normal((20, 32)) * 4
    x = (centres[rng.integers(0, 20, count)] + rng.standard_normal((count, 32))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = defaultdict(set)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    want = brute_nearest(rows, 5)
    assert sum(len(got[q] & {*v}) for q, v in want.items()) >= 0.9 * sum(map(len, want.values()))


def brute_quotes(rows):
    """{(conversation, turn): (parent, [(depth, turn)])} by comparing every quote with every earlier message."""
    plain = lambda s: re.sub(r"[\W_]+", " ", s.lower()).strip()

    def runs(text):
        found = []
        for line in text.split("\n"):
            mark = re.match(r"(?:[ \t]*>)+[ \t]?", line)
            depth, body = (mark[0].count(">"), line[mark.end() :]) if mark else (0, line)
            if not body.strip():
                found.append(None)
            elif found and found[-1] and found[-1][0] == depth:
                found[-1][1].append(body)
            else:
                found.append((depth, [body]))
        return [f for f in found if f]

    said = {k: runs(t) for k, t in rows.items()}
    passages = {}
    for k, r in said.items():
        own = [body for depth, body in r if depth == 0]
        passages[k] = {plain("\n".join(b)) for b in own} | {plain(x) for b in own for x in b} | {plain("\n".join(x for b in own for x in b))}
    out = {}
    for c, t in rows:
        earlier = sorted(s for d, s in rows if d == c and s < t)
        levels = {}
        for depth, body in said[c, t]:
            for p in [plain("\n".join(body)), *map(plain, body)]:
                for s in earlier:
                    if depth and p and p in passages[c, s]:
                        levels[depth] = max(levels.get(depth, (0, 0)), (len(p), s))
        parent = levels[1][1] if 1 in levels else (earlier[-1] if earlier else None)
        out[c, t] = (parent, [(d, s) for d, (_, s) in sorted(levels.items())])
    return out


def test_nested_quotes_against_brute_force(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    rows = {}
    for c in range(12):
        texts = {}
        for t in sorted(rng.sample(range(3000), rng.randint(3, 14))):  # turns over several stretches
            lines = []
            for _ in range(rng.randint(0, 3)):
                if texts and rng.random() < 0.8:
                    quoted = texts[rng.choice(list(texts))].split("\n")
                    at = rng.randrange(len(quoted))
                    lines += ["> " + q.upper() for q in quoted[at : at + rng.randint(1, 3)]]
                else:
                    lines.append("> " + " ".join(rng.choices(words, k=2)))
            lines += [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]
            texts[t] = "\n".join(lines)
        rows |= {(c, t): x for t, x in texts.items()}
    out = link_quotes(spark.createDataFrame([(c, t, "user", x) for (c, t), x in rows.items()], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, [tuple(q) for q in r.quoted]) for r in out} == brute_quotes(rows)
    assert max(r.quote_depth for r in out) > 1 and any(len(r.quoted) > 1 for r in out)
    for c in range(12):
        mine = {r.turn: r for r in out if r.conv_id == c}
        assert {t: (r.thread_turn, r.thread_place, r.place) for t, r in mine.items()} == brute_threads({t: r.parent_turn for t, r in mine.items()})


def brute_threads(parents):
    """(thread, its number in reply order, place) of each turn, by walking down from the first."""
    turns, thread, members = sorted(parents), {}, defaultdict(list)
    for before, t in zip([None, *turns], turns):
        thread[t] = t if before is None or parents[t] != before else thread[before]
        members[thread[t]].append(t)
    order = []

    def walk(head):
        order.append(head)
        for other in sorted(h for h in members if h != head and parents[h] is not None and thread[parents[h]] == head):
            walk(other)

    walk(turns[0])
    return {t: (thread[t], order.index(thread[t]), members[thread[t]].index(t)) for t in turns}


def test_threads_of_long_chains(spark):
    """Two reply chains that alternate: every message begins a thread, and no row grows with their depth."""
    rows = [(1, t, "user", f"> say {t - 2} now\nsay {t} now" if t > 1 else f"say {t} now") for t in range(600)]
    out = {r.turn: r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[t].parent_turn == t - 2 for t in range(2, 600))
    assert {t: (r.thread_turn, r.thread_place, r.place) for t, r in out.items()} == brute_threads({t: r.parent_turn for t, r in out.items()})


def test_a_popular_line_and_a_long_message(spark):
    rows = [(1, t, "user", "yes") if t % 2 else (1, t, "user", "> yes\nno") for t in range(4000)] + [(2, 0, "user", "a"), (2, 1, "user", "> a\n" + "b\n\n" * 30_000)]
    out = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[1, t].parent_turn == (t - 1 if t else None) for t in range(0, 4000, 2)) and out[2, 1].parent_turn == 0


def test_packing_with_other_tokenizers_and_one_long_text(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello  World.\n\nHELLO", "", " leading", "word " * 60_000]
    for path in (other, PATH):
        library, got = Tokenizer.from_file(path), defaultdict(dict)
        for r in pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, size=256, end_id=1).collect():
            got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        for i, t in enumerate(texts):
            assert [x for s in sorted(got[i]) for x in got[i][s]] == library.encode(t, add_special_tokens=False).ids + [1]


def test_mixing_against_a_plain_interleaving(spark):
    """Sources in equal weights, as long as all last, take turns block by block within one block of their share."""
    rows = [(i, f"s{i % 4}") for i in range(2000)] + [(None, "s0")] * 30 + [(5, "s1")] * 30
    frame = spark.createDataFrame(rows, "doc_id long, source string").repartition(7)
    weights = {f"s{k}": w for k, w in enumerate([4, 3, 2, 1])}
    out = mix_sources(frame, weights, block_rows=5).orderBy("mix_position").collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows) and len({r.mix_position for r in out}) == len(rows)
    again = mix_sources(frame.repartition(3), weights, block_rows=5).orderBy("mix_position").collect()
    assert [tuple(r) for r in out] == [tuple(r) for r in again]
    slots = sorted({(r.mix_slot, r.source) for r in out})
    sizes, held = Counter(s for _, s in slots), Counter()
    for n, (_, source) in enumerate(slots, 1):
        held[source] += 1
        if all(held[s] < sizes[s] for s in weights):
            assert all(abs(held[s] - n * w / 10) < 1.05 for s, w in weights.items())


def test_mixing_with_many_sources(spark):
    rows = [(i, f"s{i % 700}") for i in range(4000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=2).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter(rows) and len({r.mix_position for r in out}) == len(rows)


def odd_corpus():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(400)]
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=30)) for _ in range(4)), "en", rng.choice(["a", "b", None]), 7) for i in range(60)]
    docs += [(100 + i, docs[i][1], "en", "a", 7) for i in range(10)] + [(200 + i, docs[i][1].replace("word1 ", "word2 "), "en", "b", 7) for i in range(10)]
    return docs + [(None, docs[3][1], None, None, None), (300, None, "en", "a", None), (301, "", "en", "a", 0), (5, docs[5][1], "en", "a", 7), (302, "word " * 30_000, "en", "c", 7)]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = odd_corpus()
    labels = [(d[0], 1) for d in docs[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.createDataFrame([(*d, 9) for d in docs], DOCS + ", component_id int")
    stages = dict(corpus_pipeline.STAGES)

    kept = [tuple(r) for r in stages["quality_rules"](spark, frame, str(tmp_path)).collect()]
    statistics = lambda t: brute_statistics(t)
    fails = lambda t: statistics(t)[0] < 20 or 100 * statistics(t)[4] > 30 * statistics(t)[0]
    assert Counter(kept) == Counter(d for d in docs if not fails(d[1]))

    lines = [tuple(r) for r in stages["line_dedup"](spark, spark.createDataFrame(kept, DOCS), "").collect()]
    want = brute_lines({(d[0], d[1]) for d in kept})
    assert Counter((d[0], d[1]) for d in lines) == Counter((d[0], d[1] if d[0] is None else want[d[0]]) for d in kept)

    near = [tuple(r) for r in stages["near_dedup"](spark, spark.createDataFrame(kept, DOCS), "").collect()]
    groups = brute_groups({(d[0], d[1]) for d in kept if d[0] is not None}, 5, 80)
    assert Counter(near) == Counter(d for d in kept if d[0] is None or groups[d[0]][1] == d[0])

    mixed = [tuple(r) for r in stages["mixing"](spark, spark.createDataFrame(near, DOCS), "").collect()]
    assert Counter(mixed) == Counter(near)
    library, got = Tokenizer.from_file(PATH), Counter()
    for r in stages["packing"](spark, spark.createDataFrame(mixed, DOCS), "").collect():
        got[r.doc_id] += r.length
    ids = Counter()
    for d in mixed:
        ids[d[0]] += len(library.encode(d[1] or "", add_special_tokens=False).ids) + 1
    assert got == ids
    empty = frame.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def plain_edf(weights):
    """(source, place in its period) by slot: of all blocks that may start, the one due first."""
    period = sum(weights.values())
    waiting = [(-(-(i + 1) * period // w), i * period // w, s, i) for s, w in weights.items() for i in range(w)]
    order = []
    for slot in range(period):
        best = min(b for b in waiting if b[1] <= slot)
        waiting.remove(best)
        order.append((best[2], best[3]))
    return order


def test_mixed_order_against_plain_earliest_deadline_first(spark):
    sizes = {"a": 900, "b": 333, "c": 61, "d": 5}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    out = mix_sources(spark.createDataFrame(rows, "doc_id string, source string").repartition(5), weights, block_rows=1).orderBy("mix_position").collect()
    left, want = dict(sizes), []
    while left:
        share = whole_weights({f"={s}": weights[s] for s in left}, 1000)
        plan = [s[1:] for s, _ in plain_edf(share)]
        while all(left.values()):  # one period after the other; a source that has nothing left is passed over
            for s in plan:
                if left[s]:
                    want.append(s)
                    left[s] -= 1
        left = {s: n for s, n in left.items() if n}
    assert [r.source for r in out] == want


def test_schedule_is_linear_in_sources():
    blocks = {f"s{i}": 1 + i * 7919 % 5000 for i in range(10_000)}
    stretches, slots, _ = schedule(blocks, {s: n**0.5 for s, n in blocks.items()})
    assert len(slots) < 500_000 and len(stretches) < 500_000
    held = Counter()
    for _, s, first, end, *_ in stretches:
        assert first == held[s]
        held[s] = end
    assert held == Counter(blocks)
    small = {f"s{i}": 1 + i * 37 % 90 for i in range(150)}
    stretches, slots, end = schedule(small, dict.fromkeys(small, 1.0))
    at = {(n, s, i): slot for n, s, i, slot, *_ in slots}
    placed = [start + (b - first) // each * period + at[n, s, (b - first) % each] for n, s, first, stop, each, start, period in stretches for b in range(first, stop)]
    assert len(placed) == len(set(placed)) == sum(small.values()) and max(placed) < end


def test_rows_in_written_order(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("(id * 7919) % 20000 AS k", "repeat('x', cast(id % 50 AS int)) AS t")
    rows.repartitionByRange(13, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "t"))
    got = [r.k for r in in_written_order(spark.read.parquet(str(tmp_path / "t"))).collect()]
    assert got == list(range(20_000))
    assert in_written_order(spark.createDataFrame([], "k long")).count() == 0
