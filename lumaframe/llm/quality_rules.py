"""Quality filtering by a decision list learned from labelled text statistics.

Statistics and verdicts are Spark expressions. The list is learned by
sequential covering from a bounded sample of labelled documents and comes back
as one ordered conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Windows of so many words count as repeated text when a text has them twice.
WINDOW = 8
#: Labelled documents that the list is learned from, at most.
SAMPLE = 4000


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_exclaims (long).

    Existing columns of these names are replaced. A null text has no words.
    All work is inside the row: nothing is exploded or shuffled.
    """
    kept = [c for c in docs.columns if c not in STATISTICS]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    without = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    chars = F.char_length(text)
    step = docs.select(
        *kept,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        without(SPACE).cast("long").alias("word_chars"),
        (chars - without(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (chars - without(r"\p{Lu}")).cast("long").alias("n_upper"),
        (chars - without("!")).cast("long").alias("n_exclaims"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    n = F.size("_words")
    step = step.select(
        *[c for c in step.columns if c not in ("_words", "_lines")],
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    starts = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + j) for j in range(WINDOW)]))
    step = step.withColumn("_windows", F.when(F.size("_hashes") >= WINDOW, windows)).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    tagged = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_sorted", F.when(repeats, tagged)).drop("_windows")
    same = lambda x, i: F.coalesce(F.get(F.col("_sorted"), i)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1))
    step = step.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("_sorted")
    covered = F.transform("_starts", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), p - F.get(F.col("_starts"), k - 1)), F.lit(WINDOW)))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    made = {c: F.col(c) for c in STATISTICS} | {"n_repeat_words": F.coalesce(total, F.lit(0).cast("long"))}
    # Generated columns are computed once for a row; filters on them stay above, filters on other columns still go below.
    return step.select(*kept, F.inline(F.array(F.struct(*[x.alias(c) for c, x in made.items()]))))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaims"]

#: What the conditions of a rule compare: shares and means of the statistics, 0 for texts without words.
FEATURES = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_share": ("n_exclaims", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "n_words": ("n_words", None),
}


def feature(name: str) -> Column:
    above, below = FEATURES[name]
    if below is None:
        return F.col(above).cast("double")
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        """x: a column for each of FEATURES."""
        values = x[:, list(FEATURES).index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        value = feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(x) for c in rule], np.ones(len(x), bool))


def _gain(p: np.ndarray, n: np.ndarray, before: float) -> np.ndarray:
    """Information gained on the bad ones covered: p of n are bad."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / n) - before), -np.inf)


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> Rule:
    """Add the condition of the largest information gain until no good document is covered."""
    rule: Rule = ()
    while len(rule) < most and 0 < bad.sum() < len(bad):
        before, best = np.log2(bad.sum() / len(bad)), (1e-9, None)
        for f, name in enumerate(FEATURES):
            order = np.argsort(x[:, f], kind="stable")
            values, below = x[order, f], np.cumsum(bad[order])
            cuts = np.flatnonzero(values[1:] > values[:-1])
            for above in (True, False):
                p, n = (below[-1] - below[cuts], len(values) - 1 - cuts) if above else (below[cuts], cuts + 1)
                gains = _gain(p, n, before)
                if len(cuts) and gains.max() > best[0]:
                    at = cuts[gains.argmax()]
                    best = gains.max(), Condition(name, above, float((values[at] + values[at + 1]) / 2))
        if best[1] is None:
            break
        held = best[1].holds(x)
        rule, x, bad = (*rule, best[1]), x[held], bad[held]
    return rule


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray) -> float:
    held = bad[_covers(rule, x)]
    return float(2 * held.mean() - 1) if len(held) else -1.0


def learn_rules(x: np.ndarray, bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.97) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds, prune its last conditions on the rest, drop what it covers, again.

    x: a column for each of FEATURES. A rule is accepted if, of all rows left
    that it covers, at least ``precision`` are bad.
    """
    rules: list[Rule] = []
    while len(rules) < most_rules and bad.any():
        prune = np.arange(len(x)) % 3 == 0
        grown = _grow(x[~prune], bad[~prune], most_conditions)
        if not grown:
            break
        pruned = max((grown[:n] for n in range(1, len(grown) + 1)), key=lambda r: (_worth(r, x[prune], bad[prune]), -len(r)))
        for rule in (pruned, grown):
            held = _covers(rule, x)
            if bad[held].sum() >= max(2, precision * held.sum()):
                break
        else:
            break
        rules.append(rule)
        x, bad = x[~held], bad[~held]
    return rules


def rules_verdict(rules: list[Rule]) -> Column:
    """True unless a rule of the list, in order, rejects."""
    chain = None
    for rule in rules:
        condition = reduce(lambda a, b: a & b, [c.column() for c in rule])
        chain = F.when(condition, False) if chain is None else chain.when(condition, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled documents, those of the smallest id hashes.

    labels: id_col and quality (1 good, 0 bad); null ids and labels are left
    out, and so are ids whose labels disagree. Only the sample's ids are sent
    to the executors and only its statistics come back. Documents that fail
    the base rules teach nothing. Where ids repeat in ``docs``, the first
    ``sample`` rows by id hash, id and statistics teach. Without labelled
    documents the list is empty and rejects nothing.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col("quality").alias("_quality")).dropna()
    chosen = chosen.groupBy("_id").agg(F.min("_quality").alias("_quality"), F.max("_quality").alias("_most")).where("_quality = _most").drop("_most")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    taught = text_statistics(texts, "_text").where(~base_failed())
    rows = taught.select(F.xxhash64("_id").alias("order"), "_id", (F.col("_quality") == 0).alias("bad"), *[feature(f).alias(f) for f in FEATURES])
    rows = rows.orderBy("order", "_id", *FEATURES).limit(sample).collect()
    return learn_rules(np.array([r[3:] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.bad for r in rows], bool))


def judge_quality(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed and kept.

    Rows are neither dropped nor merged: null or repeated ids and repeated
    rows are judged like any other, each by its own text. A null or empty text
    has no words and fails the base rules. Existing columns of the made names
    are replaced.
    """
    return text_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & rules_verdict(rules))
