"""Operators on small literal tables."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions import url as U
from gleaner.functions.page import contacts, job_posting, label_pairs, parse
from gleaner.operators import dedupe, funnel, matching, merge, ranking, store
from gleaner.operators.components import connected_components
from gleaner.operators.relevance import Query, with_relevance
from gleaner.operators.scoring import Rule, score
from gleaner.sources.cursor import Batch, CursorSource, walk
from gleaner.sources.planning import branch_query, category_prefixes, job_board_term, run_budget, select_sources
from gleaner.streaming.changes import changes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_components_of_chain_star_and_repeats(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(1, 2), (2, 1), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in [100, *range(200, 230)]}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_dedupe_points_add_up_and_null_keys_never_match(spark):
    rows = spark.createDataFrame([(1, "k", "t"), (2, "k", "t"), (3, None, "t"), (4, None, None)], "ord long, key string, tag string")
    signals = [dedupe.ExactSignal("key", 40, F.col("key")), dedupe.ExactSignal("tag", 40, F.col("tag"))]
    got = {(r.a, r.b): (r.score, r.signals, r.decision) for r in dedupe.duplicate_pairs(rows, signals, 90, 40).collect()}
    assert got == {(1, 2): (80, ["key", "tag"], "possible_duplicate"), (1, 3): (40, ["tag"], "possible_duplicate"), (2, 3): (40, ["tag"], "possible_duplicate")}


def test_distance_signal(spark):
    rows = spark.createDataFrame([(1, 52.0, 5.0), (2, 52.000003, 5.0), (3, 52.005, 5.0)], "ord long, lat double, lon double")
    near = dedupe.DistanceSignal("near", 60, 50.0, F.col("lat"), F.col("lon"))
    assert [(r.a, r.b) for r in dedupe.duplicate_pairs(rows, [near], 90, 40).collect()] == [(1, 2)]


def test_survivor_has_best_score_and_earliest_wins(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, 9), (4, 1)], "ord long, points int")
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    got = {r.ord: (r.component, r.survivor) for r in dedupe.collapse(rows, links, F.col("points")).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 4)}


def test_scoring_clamps_caps_and_splits_reasons(spark):
    rules = [Rule("a", F.lit(True), 90), Rule("b", F.lit(True), 90), Rule("c", F.lit(True), -10), Rule("z", F.lit(True), 0), Rule("n", F.lit(None).cast("boolean"), 5)]
    got = one(spark, score(rules, cap=lambda raw: F.lit(40)))
    assert (got.score, got.fired, got.positive, got.negative) == (40, ["a", "b", "c", "z"], ["a", "b"], ["c"])


def test_latest_non_null_keeps_null_of_latest_fields(spark):
    rows = spark.createDataFrame([(1, 1, "old", "x"), (1, 2, None, None)], "k int, o int, picked string, latest string")
    got = merge.latest_non_null(rows, ["k"], F.col("o"), ["picked"], ["latest"]).first()
    assert (got.picked, got.latest) == ("old", None)


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "k int, v string, o int")
    incoming = spark.createDataFrame([(1, "a", 9), (2, None, 9), (3, "d", 9)], "k int, v string, o int")
    first = {r.k: r.action for r in merge.split_upsert(stored, incoming, "k", ["v"], "o").collect()}
    last = {r.k: r.action for r in merge.split_upsert(stored, incoming, "k", ["v"], "o", last_stored_wins=True).collect()}
    assert first == {1: "unchanged", 2: "unchanged", 3: "new"} and last[1] == "updated"


def test_insert_missing_is_null_safe(spark):
    have = spark.createDataFrame([(1, None)], "a int, b string")
    rows = spark.createDataFrame([(1, None), (1, "x"), (1, "x"), (2, None)], "a int, b string")
    assert sorted((r.a, r.b or "") for r in store.insert_missing(have, rows, ["a", "b"]).collect()) == [(1, "x"), (2, "")]


def test_breakdown_invariant(spark):
    sites = spark.createDataFrame([("s", 10, 8, 5), ("t", 3, 3, 3)], "site string, discovered long, attempted long, with_data long")
    kinds = ["new", "date_rejected", "duplicate_in_run", "already_known"]
    facts = spark.createDataFrame([("s", i % 3 > 0, kinds[i % 4], i % 2 == 0) for i in range(7)] + [("t", True, "new", True)] * 3, "site string, relevant boolean, outcome string, stored boolean")
    for r in funnel.run_breakdown(sites, facts).collect():
        exclusive = r.not_processed + r.no_usable_data + r.rejected_by_relevance + r.rejected_by_date + r.duplicates_in_run + r.already_known + r.cut_by_target + r.new_records
        assert r.discovered + r.multi_record_extra == exclusive


def test_urls(spark):
    n = lambda u, **k: one(spark, U.normalize_url(F.lit(u), **k))
    assert n("HTTPS://WWW.Example.COM/a?b=2&utm_source=x&a=1#top") == "https://www.example.com/a?a=1&b=2"
    assert n("https://e.com?ref=1", tracking=U.SEARCH_TRACKING) == "https://e.com/"
    assert n("ftp://e.com/") is None and n("https://u:p@e.com/") is None
    assert one(spark, U.registrable_domain(F.lit("www.shop.example.co.uk"))) == "example.co.uk"
    assert one(spark, U.job_identity(F.lit("https://www.a.nl/x/what:job/jobID:123"))) == "https://a.nl|what:job|jobid|123"
    assert one(spark, U.job_identity(F.lit("https://a.nl/jobs/plain"))) is None


def test_ranks(spark):
    r = one(spark, ranking.rank_vacancy_link(F.lit("https://a.nl/vacatures/data-engineer-123"), F.lit("Data engineer"), F.lit("sitemap")))
    assert (r.score, r.classification) == (10 + 20 + 45 + 25 + 5 + 10, "detail")
    r = one(spark, ranking.rank_tender_link(F.lit("https://a.nl/aanbestedingen?page=2"), F.lit("")))
    assert (r.score, r.reasons, r.classification) == (15, ["tender_listing_path", "pagination"], "pagination")


def test_relevance(spark):
    rows = spark.createDataFrame([(1, "Security Officer", "x", None), (2, "Onderwijsassistent", "x", None), (3, "Kok", "x", "Utrecht"), (4, None, None, None)], "id int, title string, description string, place string")

    def reasons(q):
        out = with_relevance(rows.withColumn("company", F.lit(None).cast("string")), "title", "description", "company", F.lit(None).cast("string"), F.col("place"), q)
        return {r.id: r.relevance.reason for r in out.collect()}

    assert reasons(Query.parse("security", "security officer", "Utrecht")) == {1: "title_branch_match", 2: "rejected_no_match", 3: "rejected_no_match", 4: "rejected_no_match"}
    assert reasons(Query.parse("onderwijs"))[2] == "title_branch_match"
    assert set(reasons(Query.parse("")).values()) == {"rejected_no_query_terms"}


def test_text(spark):
    assert one(spark, T.sentences(F.lit("Een. Twee! ab\nDrie"))) == ["Een.", "Twee!", "Drie"]
    assert one(spark, T.slugify(F.lit("Één Café!"))) == "een-cafe"
    assert one(spark, T.null_if_longer(F.lit("abc"), 2)) is None and one(spark, T.cut_to(F.lit("abc"), 2)) == "ab"
    assert one(spark, T.after_label(F.lit("Info. Locatie: Utrecht. Meer"), ["Locatie"])) == "Utrecht"
    assert one(spark, matching.tokens_match(matching.name_tokens(F.lit("gemeente utrecht")), matching.name_tokens(F.lit("utrecht stad")))) is True


def test_pages():
    root = parse('<title>T</title><a href="mailto:Info@Site.nl?x">m</a><a href="https://facebook.com/sharer">s</a><a href="https://instagram.com/ons">i</a><dl><dt>Bedrijf:</dt><dd>Acme</dd></dl><p>a<p>b')
    assert contacts(root) == {"email": "info@site.nl", "phone": None, "whatsapp": None, "instagram": "ons", "facebook": None}
    assert label_pairs(root) == [("Bedrijf", "Acme")] and job_posting(root)["company"] == "Acme"
    post = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Kok","datePosted":"2026-01-02T00:00","hiringOrganization":{"name":"X"}}]}</script>'
    got = job_posting(parse(post))
    assert (got["title"], got["company"], got["posted_date"]) == ("Kok", "X", "2026-01-02")
    assert job_posting(parse(post * 2))["title"] is None and parse(None).text() == ""


def test_walk_limits():
    def fetch(cursor, n):
        at = int(cursor or 0)
        return Batch([{"id": i} for i in range(at, min(at + n, 10))], str(min(at + n, 10)), at + n >= 10)

    assert [i["id"] for i in walk(fetch, 4, 6, 9).items] == list(range(6)) and walk(fetch, 4, 6, 9).reason == "item_limit"
    assert walk(fetch, 4, 100, 2).reason == "batch_limit" and walk(fetch, 4, 100, 9).reason == "exhausted"
    assert walk(lambda c, n: Batch([], c, False), 4, 10, 9).reason == "no_progress"
    with pytest.raises(ValueError):
        walk(lambda c, n: Batch([{}] * (n + 1), "x", False), 4, 10, 9)


def test_planning():
    assert branch_query(" zorg ", "nacht", "Utrecht") == "zorg nacht Utrecht" and job_board_term("zorg", " ") == "zorg"
    assert category_prefixes(["45000000", "45100000"]) == ["45", "451"]
    assert run_budget(10).pages == 30 and run_budget(1000).target == 100
    assert select_sources({"a": ["wide"], "b": ["narrow"]}, "wide", ["b", "z"]).unknown == ["z"]


def test_cursor_stream_reads_everything_once(spark, tmp_path):
    spark.dataSource.register(CursorSource)
    rows = spark.readStream.format("cursor").option("total", 25).option("batch", 10).load()
    seen = []
    query = rows.writeStream.foreachBatch(lambda df, i: seen.extend(r.external_id for r in df.collect())).option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == sorted(set(seen)) and set(seen) <= set(range(25)) and seen


def test_change_states(spark, tmp_path):
    spark.createDataFrame([("a", "1", 3), ("a", "1", 1), ("b", "2", 2), ("a", "0", 2)], "k string, v string, n int").repartition(4).write.parquet(str(tmp_path / "in"))
    items = spark.readStream.schema("k string, v string, n int").parquet(str(tmp_path / "in"))
    query = changes(items, "k", "v", "n").writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.key, r.ord, r.state) for r in spark.table("states").collect()) == [("a", 1, "new"), ("a", 2, "changed"), ("a", 3, "changed"), ("b", 2, "new")]


def test_core_names_no_domain_and_not_the_training_package():
    root = Path(__file__).parent.parent / "gleaner"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "gleaner.llm" not in f.read_text(), f
    for f in (root / "operators").glob("*.py"):
        if f.stem in ("scoring", "dedupe", "merge", "components", "storage", "store", "funnel"):
            assert not re.search(r"vacanc|tender", f.read_text()), f
