"""Quality rules: a decision list learned by sequential covering.

Statistics of a text are native column expressions. A bounded sample of
labelled rows (``SAMPLE_ROWS``, the rows with the smallest hash of doc_id)
teaches an ordered list of threshold conjunctions that describe bad texts:
each is grown by information gain on two thirds of the sample, pruned on the
remaining third, and kept while its precision there holds. The list becomes one
Spark ``CASE`` expression, applied to every row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, table

SAMPLE_ROWS = 4096
WINDOW = 5
#: What a rule may test; ``c`` gives a count of ``text_stats`` by name.
FEATURES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "mean_word": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "dup_lines": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeats": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
    "words": lambda c: c("n_words").cast("double"),
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self, c: Callable[[str], Column]) -> Column:
        value = FEATURES[self.feature](c)
        return value > self.threshold if self.above else value <= self.threshold


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of five that occur twice or more, each word counted once."""

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        )

        def covered(w: Column) -> Column:
            ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def spans(s: Column) -> Column:
                again = F.filter(
                    s,
                    lambda e, k: (F.get(s, k - 1)["x"] == e["x"]).eqNullSafe(True)
                    | (F.get(s, k + 1)["x"] == e["x"]).eqNullSafe(True),
                )
                starts = F.sort_array(F.transform(again, lambda e: e["i"]))
                steps = let(
                    starts,
                    lambda p: F.transform(
                        p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))
                    ),
                )
                return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(
                let(ranked, spans)
            )

        return let(windows, covered)

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(n < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(hashed)


def text_stats(text: Column) -> Column:
    """A struct of counts of one text; null and empty texts have zero of everything.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes, within one text only.
    """

    def of_text(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(SPACES))
        words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
            F.split(trimmed, f"{SPACE_CLASS}+")
        )
        lines = F.split(t, "\n")
        said = F.filter(lines, lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)

        def of_words(w: Column) -> Column:
            n = F.size(w)
            return F.struct(
                n.cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                F.size(lines).cast("bigint").alias("n_lines"),
                let(said, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("bigint")).alias("n_dup_lines"),
                _repeat_words(w, n).alias("n_repeat_words"),
            )

        return let(words, of_words)

    return let(F.coalesce(text, F.lit("")), of_text)


def base_failed(c: Callable[[str], Column] = F.col) -> Column:
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return -1.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def _thresholds(values: list[float], steps: int = 16) -> list[float]:
    distinct = sorted(set(values))
    middles = [(a + b) / 2 for a, b in zip(distinct, distinct[1:], strict=False)]
    if len(middles) <= steps:
        return middles
    return sorted({middles[i * (len(middles) - 1) // (steps - 1)] for i in range(steps)})


def _grow(rows: list[dict], longest: int) -> list[Test]:
    rule: list[Test] = []
    while len(rule) < longest:
        bad = sum(r["bad"] for r in rows)
        good = len(rows) - bad
        if not bad or not good:
            break
        best, best_gain = None, 1e-9
        for f in FEATURES:
            for t in _thresholds([r[f] for r in rows]):
                over = [r["bad"] for r in rows if r[f] > t]
                b, g = sum(over), len(over) - sum(over)
                for above, nb, ng in ((True, b, g), (False, bad - b, good - g)):
                    if (value := _gain(nb, ng, bad, good)) > best_gain:
                        best, best_gain = Test(f, above, t), value
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _covers(rule: list[Test], row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def _precision(rule: list[Test], rows: list[dict]) -> float:
    """Share of bad rows among those that the rule covers, as if one row of either kind had been seen before."""
    hit = [r["bad"] for r in rows if _covers(rule, r)]
    return (sum(hit) + 1) / (len(hit) + 2)


def learn(rows: list[dict], precision: float = 0.9, longest: int = 3, most_rules: int = 12) -> list[list[Test]]:
    """Rules for bad rows, in order. ``rows`` are features with a key ``bad`` (0 or 1).

    Each rule is grown on two thirds of the rows that are left, loses the tests at its end whose removal the last
    third does not mind, and is kept if of all rows left that it covers at least ``precision`` are bad, and half on
    the last third. A rule that fails is dropped, and the bad rows it was grown for are set aside, so that the next
    one describes others. Ties go to the feature that comes first in ``FEATURES`` and the smaller threshold.
    """
    rules: list[list[Test]] = []
    left, aside = list(enumerate(rows)), set()
    tries = 0
    while len(rules) < most_rules and tries < 2 * most_rules:
        tries += 1
        grow = [r for i, r in left if i % 3 and i not in aside]
        prune = [r for i, r in left if i % 3 == 0]
        rule = grown = _grow(grow, longest)
        if not rule:
            break
        while len(rule) > 1 and _precision(rule[:-1], prune) >= _precision(rule, prune):
            rule = rule[:-1]
        hit = [r["bad"] for _, r in left if _covers(rule, r)]
        held = [r["bad"] for r in prune if _covers(rule, r)]
        if sum(hit) >= precision * len(hit) and 2 * sum(held) >= len(held):
            rules.append(rule)
            left = [(i, r) for i, r in left if not _covers(rule, r)]
        else:
            known = len(aside)
            aside |= {i for i, r in left if r["bad"] and _covers(grown, r)}
            if len(aside) == known:
                break
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Test]]:
    """Learn the list from at most ``sample_rows`` labelled rows; no labels give no rules (all texts pass).

    Rows that the base rejects teach nothing: the list decides on those that are left. A document with several
    labels counts as bad if one says so.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    stats = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "quality", text_stats(F.col("text")).alias("s"))
        .select("doc_id", "quality", "s.*")
    )
    # what the base rejects is left out on the driver: as a filter it would count every text a second time
    got = stats.select("doc_id", base_failed().alias("failed"), (1 - F.col("quality")).alias("bad"), *(e(F.col).alias(f) for f, e in FEATURES.items()))
    rows = got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    return learn([{k: v for k, v in r.asDict().items() if k != "failed"} for r in rows if not r["failed"]])


def verdict(rules: list[list[Test]], c: Callable[[str], Column] = F.col) -> Column:
    """The list as one ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        condition = reduce(and_, (t.column(c) for t in rule))
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    A null text has zero words, so it fails the base. Very long texts are counted
    whole. Values at a threshold are on its lower side. Repeated rows give repeated
    results, an empty table an empty one. Further columns of ``docs``, whatever
    their names, are not read.
    """
    stats = docs.select("doc_id", text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def keep_good(docs: DataFrame, rules: list[list[Test]]) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""

    def passes(s: Column) -> Column:
        return ~base_failed(s.getField) & verdict(rules, s.getField)

    return docs.where(let(text_stats(F.col("text")), passes))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, one row for each row."""
    docs = table(spark, sf_dir, "documents")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
