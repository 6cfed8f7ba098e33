"""What held at a moment and from when to when, against brute force."""

import datetime as dt
import random

from gleaner.operators import versions


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of(spark):
    rng = random.Random(2)
    observed = [(k, day(d), rng.choice([None, "x", "y"])) for k in range(4) for d in sorted(rng.sample(range(400), 30))] + [(9, day(3), "z"), (None, day(1), "n"), (1, None, "n")]
    asked = [(i, rng.randrange(6), day(rng.randrange(-30, 450))) for i in range(300)] + [(300, None, day(1)), (301, 1, None), (301, 1, None), (302, 9, day(399))]
    got = versions.as_of(spark.createDataFrame(asked, "q long, k int, day date"), spark.createDataFrame(observed, "k int, seen date, said string"), "k", "day", "seen", ["said"])
    assert got.columns == ["q", "k", "day", "said"]
    want = []
    for q, k, at in asked:
        before = [(s, v) for kk, s, v in observed if kk is not None and kk == k and s is not None and at is not None and s <= at]
        want.append((q, k, at, max(before)[1] if before else None) if before and max(before)[1] is not None or not before else (q, k, at, None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_as_of_one_record(spark):
    """A record with all observations is split by spans of time."""
    seen = spark.range(20_000).selectExpr("1 as k", "date_add(date'2000-01-01', cast(id % 9000 as int)) as seen", "id as said").groupBy("k", "seen").agg({"said": "max"}).toDF("k", "seen", "said")
    asked = spark.range(9000).selectExpr("id as q", "1 as k", "date_add(date'2000-01-01', cast(id as int)) as day")
    got = versions.as_of(asked, seen, "k", "day", "seen", ["said"]).collect()
    assert len(got) == 9000 and all(r.said % 9000 == r.q for r in got)


def test_validity(spark):
    rows = [(1, day(0), "a"), (1, day(5), "a"), (1, day(40), "a"), (1, day(41), "b"), (1, day(90), None), (1, day(91), None), (1, day(130), "b"), (2, day(1), None), (None, day(1), "x")]
    got = versions.validity(spark.createDataFrame(rows, "k int, seen date, said string"), "k", "seen", ["said"]).orderBy("k", "valid_from").collect()
    assert [tuple(r) for r in got] == [(1, "a", day(0), day(41)), (1, "b", day(41), day(90)), (1, None, day(90), day(130)), (1, "b", day(130), None), (2, None, day(1), None)]
    assert versions.validity(spark.createDataFrame([], "k int, seen date, said string"), "k", "seen", ["said"]).count() == 0
