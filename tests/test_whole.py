"""Queries on tables where a cut would show."""

import duckdb
import pytest

from gleaner.plans import feeds, runs


@pytest.fixture
def sf(tmp_path):
    return str(tmp_path)


def test_strength_counts_all_orders_and_evidence_the_largest(spark, sf):
    rows = [(1, "A", o, q, "F") for o, q in enumerate([5.0, 6.0, 7.0, 8.0, 50.0, 40.0])] + [(1, "R", o, 30.0, "O") for o in range(5)]
    rows += [(2, "A", 1, None, "F"), (2, "A", 9, 31.0, "O"), (2, "A", 9, 1.0, "O"), (2, "A", 1, 30.0, "O")]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_orderkey long, l_quantity double, l_linestatus string").write.parquet(f"{sf}/lineitem.parquet")
    got = {(r.l_suppkey, r.activity): (r.strength, r.evidence) for r in runs.activity_merge(spark, sf).collect()}
    assert got == {(1, "A"): ("strong", "4,5,3"), (1, "R"): ("weak", "0,1,2"), (2, "A"): ("strong", "1,9")}


def test_sitemaps_keep_every_page(spark, sf):
    pages = spark.range(60_000).selectExpr("id * 7 + 3 AS page_id", "concat('http://a.com/en/', id, '?a=1&b=2') AS url")
    repeated = spark.range(3_000).selectExpr("4L AS page_id", "concat('http://a.com/de/', lpad(id, 5, '0')) AS url")
    pages.unionByName(repeated).write.parquet(f"{sf}/pages.parquet")
    got = feeds.sitemap_links(spark, sf)
    assert {(r.file, r.ord, r.location) for r in got.where("ord % 997 = 0 or ord >= 59990").collect()} == {
        ("en-3", i, f"http://a.com/en/{i}?a=1&b=2") for i in range(60_000) if i % 997 == 0 or i >= 59_990
    } | {("de-4", i, f"http://a.com/de/{i:05}") for i in range(0, 3_000, 997)}
    assert got.count() == 63_000
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet/*.parquet' where page_id <> 4")
    assert sorted(map(tuple, got.where("file = 'en-3'").select("file", "ord", "location").collect())) == sorted(con.execute(feeds.ORACLES["sitemap_links"]).fetchall())


def test_ranges_of_content_change_meet(spark, monkeypatch):
    """Borders between ranges change nothing."""
    from gleaner.plans import stores

    said = lambda: sorted(map(tuple, stores.content_change(spark, "/root/testdata/sf0.01").collect()))
    whole = said()
    monkeypatch.setattr(stores, "RANGE", 7)
    assert said() == whole
