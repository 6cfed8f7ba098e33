"""Rows paired by their classes, against all pairs."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from gleaner.operators import classes, dedupe, matching


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_row_pairs(spark):
    """Two classes in several tiles, one with itself, and one in order only: each pair once, none of others."""
    rep = {i: (0 if i % 3 == 0 else 1 if i % 3 == 1 else 2) for i in range(40)}
    members = spark.createDataFrame(list(rep.items()), "ord long, rep long")
    linked = spark.createDataFrame([(0, 0, True), (0, 1, False), (1, 2, True), (9, 0, False)], "x long, y long, in_order boolean")
    got = [tuple(r) for r in classes.row_pairs(members, linked, 3).collect()]
    want = {(a, b) for a, b in combinations(range(40), 2) if {rep[a], rep[b]} in ({0}, {0, 1}) or (rep[a], rep[b]) == (1, 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_at_one_place(spark):
    """Many records of few places: places are compared, and no table of pairs is grouped."""
    near = dedupe.DistanceSignal("near", 60, 900.0, F.col("lat"), F.col("lon"))
    placed = spark.range(60).select(F.col("id").alias("ord"), F.when(F.col("id") != 59, 52.0 + (F.col("id") % 3) * 0.005).alias("lat"), F.lit(5.0).alias("lon"))
    pairs = dedupe.duplicate_pairs(placed, [near], 90, 40)
    # steps of 556 metres: neighbours are near, the first and the last place are not
    want = {(a, b) for a, b in combinations(range(59), 2) if abs(a % 3 - b % 3) < 2}
    assert {(r.a, r.b) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert {(r.score, tuple(r.signals), r.decision) for r in pairs.collect()} == {(60, ("near",), "possible_duplicate")}
    assert "Aggregate [a#" not in _plan(pairs)


def test_names_as_classes(spark):
    """Names with repeated words, of equal and unequal length and in blocks: the same pairs as comparing all; names of the same words are one class."""
    dice = random.Random(4)
    names = [(i, dice.choice(["x", "y", None]), [dice.choice(["red", "bolt", "nut", "ring", "old"]) for _ in range(dice.randint(0, 4))]) for i in range(120)]
    df = spark.createDataFrame(names, "ord long, block string, tokens array<string>")

    def match(a, b):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return len(short) > 0 and sum(w in long for w in short) / len(short) >= 0.6

    found = matching.similar_names(df, ["block"])
    got = [tuple(r) for r in found.collect()]
    want = {(a[0], b[0]) for a, b in combinations(names, 2) if a[1] is not None and a[1] == b[1] and match(a[2], b[2])}
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate [short#" not in _plan(found) and "Aggregate [block#" in _plan(found)
