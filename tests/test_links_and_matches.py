"""References as the standard resolves them, links of pages, matches without pairs, similar names, runs that replace each other."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.dom import nodes
from gleaner.functions.url import resolve
from gleaner.operators import matching, page_index, searches, statistics, store
from gleaner.operators.storage import new_path

#: The examples of RFC 3986, 5.4, on the base http://a/b/c/d;p?q.
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_resolve(spark):
    rows = spark.createDataFrame([(r,) for r in RFC], "r string").select("r", resolve(F.lit("http://a/b/c/d;p?q"), F.col("r")).alias("t")).collect()
    assert {r.r: r.t for r in rows} == RFC
    odd = spark.createDataFrame([("http://a", " g\n"), ("http://a?x", "b/c"), (None, "x"), ("http://a", None)], "b string, r string").select(resolve(F.col("b"), F.col("r"))).collect()
    assert [r[0] for r in odd] == ["http://a/g", "http://a/b/c", None, None]


def test_page_links(spark):
    html = """<base><base href="/x/y"><a href='one'>One <b>more</b></a><A HREF=../two>Two</A><a name="no">no</a><a href="mailto:a@b.nl">mail</a><a href="HTTP://Other.NL:80/p?utm_source=1&b=2&amp;a=1#t">o</a><a href="//third.nl/job/3">j</a>"""
    pages = spark.createDataFrame([(1, "https://site.nl/deep/page", html), (2, "https://site.nl/deep/page", '<base href="mailto:x"><a href="job/1">a</a><a href="job/2">b</a><a href="job/1">c</a>')], "page_id long, url string, html string")
    got = page_index.page_links(nodes(pages), pages, lambda target, label: F.contains(target, F.lit("/job/"))).orderBy("page_id", "place").collect()
    assert [(r.target, r.label, r.source) for r in got if r.page_id == 1] == [("https://site.nl/x/one", "One more", "link"), ("https://site.nl/two", "Two", "link"), ("http://other.nl/p?a=1&b=2", "o", "link"), ("https://third.nl/job/3", "j", "link")]
    assert [(r.target, r.source) for r in got if r.page_id == 2] == [("https://site.nl/deep/job/1", "listing"), ("https://site.nl/deep/job/2", "listing"), ("https://site.nl/deep/job/1", "listing")]


KEYS = [("title", 40), ("company", 30), ("url", 50), ("phone", 20)]


def test_match_any_key(spark):
    rng = random.Random(5)
    make = lambda n, start: [(start + i, *(rng.choice([None, "a", "b", "c"]) for _ in KEYS)) for i in range(n)]
    incoming, stored = make(120, 0), make(60, 1000)
    schema = "ord long, title string, company string, url string, phone string"
    got = {r.ord: (r.score, r.match, r.possible) for r in statistics.match_any_key(spark.createDataFrame(incoming, schema), spark.createDataFrame(stored, schema), KEYS, 50, 90).collect()}
    for row in incoming:
        scored = [(min(100, sum(p for (_, p), x, y in zip(KEYS, row[1:], s[1:], strict=True) if x is not None and x == y)), s[0]) for s in stored]
        best = [x for x in scored if x[0] >= 50]
        want = (max(x[0] for x in best) if best else None, min((o for p, o in best if p >= 90), default=None), bool(best))
        assert got[row[0]] == want, row


def test_match_any_key_without_pairs(spark):
    """100,000 rows of one company and title against as many: a pair of each would be ten milliards."""
    rows = spark.range(100_000).select(F.col("id").alias("ord"), F.lit("kok").alias("title"), F.lit("zaak").alias("company"), F.col("id").cast("string").alias("url"), F.lit(None).cast("string").alias("phone"))
    stored = rows.withColumn("ord", F.col("ord") + 500_000).withColumn("url", F.concat(F.lit("s"), "url"))
    got = statistics.match_any_key(rows, stored, KEYS, 50, 70).groupBy("score", "match", "possible").count().collect()
    assert [tuple(r) for r in got] == [(70, 500_000, True, 100_000)]


def test_similar_names(spark):
    rng = random.Random(9)
    words = ["bakker", "smid", "jansen", "delft", "utrecht", "groep", "zorg", "bouw"]
    names = [(i, "x" if i % 3 else "y", rng.choices(words, k=rng.randint(0, 7))) for i in range(140)] + [(900, None, ["bakker"]), (901, None, ["bakker"])]
    df = spark.createDataFrame(names, "ord long, block string, tokens array<string>")
    want = set()
    for a, b in itertools.combinations(names[:140], 2):
        short, long = (a[2], b[2]) if len(a[2]) <= len(b[2]) else (b[2], a[2])
        if a[1] == b[1] and short and sum(w in long for w in short) / len(short) >= 0.6:
            want.add((a[0], b[0]))
    assert {tuple(r) for r in matching.similar_names(df, ["block"]).collect()} == want


def test_runs_replace_each_other(spark):
    folder = new_path(spark, "runs")
    rows = lambda n: {"records": spark.range(n).toDF("id"), "sources": spark.range(1).toDF("id")}
    seen = lambda run: store.committed(spark, folder, "records").where(F.col("run") == run).count()
    store.write_run(rows(3), folder, "r/1")
    assert seen("r/1") == 3 and store.run_version(spark, folder, "r/1") == 1
    broken = rows(5) | {"sources": spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        store.write_run(broken, folder, "r/1")
    assert seen("r/1") == 3  # the run that stood is still there
    store.write_run(rows(7), folder, "r/1")
    assert seen("r/1") == 7
    with pytest.raises(store.RunConflict):
        store.write_run(rows(9), folder, "r/1", after=1)  # began when version 1 stood
    assert seen("r/1") == 7 and store.run_version(spark, folder, "r/1") == 2


def test_nothing_committed(spark):
    folder = new_path(spark, "runs")
    spark.range(2).select("id", F.lit("r").alias("run"), F.lit("a-1").alias("attempt")).write.parquet(f"{folder}/records/a-1")
    assert store.committed(spark, folder, "records").count() == 0


def test_places_keep_repeated_rows(spark):
    gazetteer = spark.createDataFrame([("place", "Delft", "delft", "ZH"), ("province", "Utrecht", "utrecht", None), ("place", "Utrecht", "utrecht", "UT")], "kind string, name string, alias string, province string")
    values = spark.createDataFrame([("Delft",), ("Delft",), ("provincie Utrecht",), ("Utrecht",), (None,), ("nergens",)], "said string")
    got = sorted((r.said or "", r.kind or "", r.name or "") for r in searches.find_places(values, "said", gazetteer).collect())
    assert got == [("", "", ""), ("Delft", "place", "Delft"), ("Delft", "place", "Delft"), ("Utrecht", "place", "Utrecht"), ("nergens", "", ""), ("provincie Utrecht", "province", "Utrecht")]
