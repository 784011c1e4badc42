"""Near-duplicate groups and line deduplication against brute force."""

import random
import re

import pytest

from lumaframe.llm.line_dedup import dedup_lines
from lumaframe.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, component_id string, n_lines long"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def brute_groups(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    docs = [None, "", " \t\n", "one", "One", "one two", "ONE  two", "a b c", "A b c", "x" * 200_000]
    for n in (5, 30, 120, 900):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = word()
            docs.append(" ".join(copy))
    chain = [word() for _ in range(100)]
    for i in range(40):  # each near the next, the ends far apart
        docs.append(" ".join(chain))
        chain[(7 * i) % 100] = word()
    return list(enumerate(docs))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, "clash", 7) for d, t in docs], SCHEMA)
    rows = near_duplicates(frame, width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(docs, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(3, text), (3, text), (None, text), (5, text), (6, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (6, 6, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_lines(docs):
    seen, gone = {}, set()
    split = {d: t.split("\n") for d, t in docs if d is not None and t is not None}
    for d in sorted(split):
        solid = [i for i, s in enumerate(split[d]) if re.search(r"[^\x20\x09-\x0d]", s)]
        for x in zip(solid, solid[1:], solid[2:], strict=False):
            key = tuple(split[d][i] for i in x)
            if seen.setdefault(key, (d, x[0])) != (d, x[0]):
                gone |= {(d, i) for i in x}
    return {d: "\n".join(s for i, s in enumerate(v) if (d, i) not in gone) for d, v in split.items()}


def test_line_dedup(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "d e", "f"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "x\ny"), (93, "p\n\nq\n \nr\ns\np\nq\nr")]
    frame = spark.createDataFrame([(d, t, "clash", 7) for d, t in docs], SCHEMA)
    rows = dedup_lines(frame).collect()
    assert {r.doc_id: r.text for r in rows if r.text is not None} == brute_lines(docs)
    assert [r.n_lines for r in rows if r.doc_id == 90] == [None] and all(r.component_id == "clash" for r in rows)
    assert next(r for r in rows if r.doc_id == 93).text == "p\n\nq\n \nr\ns"


def test_line_dedup_odd_rows(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n_removed) for r in out) == [(0, "a\nb\nc", 0), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "", 3)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
