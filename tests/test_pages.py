"""Pages as node tables, and what company pages say of a vocabulary, on literal pages."""

import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dom
from gleaner.operators import companies, page_index

PAGE = """<html><head><title>Slotenmaker Jansen | Camerabeveiliging</title><meta name="Description" content=" Sloten en meer "><meta property="og:site_name" content="Jansen">
<script type="application/ld+json">{"@type": "Product", "name": "slot"}</script></head>
<body><header><nav><a href="/a">Alarmsystemen</a> <a href="/winkelwagen">Winkelwagen</a> <a>voor installateurs</a></nav></header>
<div class="cookie-bar">Cookies: brandmelders</div>
<main><h1>Cameras en <b>sloten</b></h1><p>Wij leveren sloten aan scholen, ziekenhuizen en zorg. De zorgen van scholen kennen wij!</p>
<ul><li>Camerabeveiligingssystemen vanaf € 99,95<li>Sloten &amp; deuren • voor particulieren</ul><h2>Installateur</h2><p>Wij zijn fabrikant. Levering door groothandel</p></main>
<aside>Brandmelders</aside><footer>© 2024 Jansen Beveiliging B.V. KvK-nummer: 12345678 scholen</footer></body></html>"""
CONCEPTS = [
    ("product", "locks", "Sloten", 0, "slot", False), ("product", "locks", "Sloten", 1, "sloten", False), ("product", "locks", "Sloten", 2, "deuren", True), ("product", "cctv", "Camera's", 0, "camera", False), ("product", "cctv", "Camera's", 1, "camerabeveiliging", False),
    ("product", "fire", "Brand", 0, "brandmelder", False), ("product", "alarm", "Alarm", 0, "alarmsysteem", False), ("product", "alarm", "Alarm", 1, "alarmsystem", False),
    ("customer_sector", "schools", "Scholen", 0, "scholen", False), ("customer_sector", "care", "Zorg", 0, "zorg", False), ("role", "installer", "Installateur", 0, "installateur", False), ("role", "maker", "Fabrikant", 0, "fabrikant", False), ("role", "trade", "Groothandel", 0, "groothandel", False),
]


@pytest.fixture(scope="module")
def tree(spark):
    return dom.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "plain <b>text"), (4, "")], "page_id long, html string")).cache()


def test_numbers():
    rows = dom.number_nodes("<div><p>a<p>b<br>c</div><ul><li>x<li>y<ul><li>z</ul></ul>d")
    tags = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    assert tags[0] == (0, 6, 0, None, "div") and tags[1][:2] == (1, 2) and tags[3][:2] == (3, 6)
    assert [r[4] for r in rows if r[3] is None] == ["div", "ul", "#text"]
    inner = next(r for r in rows if r[6] == "z")
    assert [r[4] for r in rows if r[0] <= inner[0] <= r[1]] == ["ul", "li", "ul", "li", "#text"]
    for r in rows:  # intervals nest
        assert all(not (r[0] < q[0] <= r[1] < q[1]) for q in rows)
    assert dom.number_nodes(None) == [] and dom.number_nodes("</p></div>") == []


def test_nodes(tree):
    rows = tree.collect()
    assert {r.page_id for r in rows} == {1, 3} and sum(r.page_id == 3 for r in rows) == 3
    inside = tree.select("page_id", "text", dom.within(F.col("tag") == "nav").alias("nav"), dom.holder(F.col("tag") == "h1").alias("h1")).where("text is not null and trim(text) <> ''").collect()
    assert [r.text for r in inside if r.nav] == ["Alarmsystemen", "Winkelwagen", "voor installateurs"]
    assert [r.text.strip() for r in inside if r.h1 is not None] == ["Cameras en", "sloten"]


def test_statements(tree):
    r = {x.page_id: x for x in page_index.page_statements(tree).collect()}
    one = r[1]
    assert (one.title, one.description, one.site_name) == ("Slotenmaker Jansen | Camerabeveiliging", "Sloten en meer", "Jansen")
    assert (one.legal_name, one.registration, one.cart, one.prices, one.product_data) == ("Jansen Beveiliging B.V.", "12345678", True, 1, True)
    assert one.consumer_cues == ["voor particulieren"] and one.business_cues == ["groothandel"]
    assert r[3].title is None and r[3].n_chars == 10 and not r[3].cart


@pytest.fixture(scope="module")
def hits(spark, tree):
    pages = spark.createDataFrame([(1, "/sectoren/camera-systemen", "sectors", "Slotenmaker Jansen"), (3, "/x", "other", None)], "page_id long, path string, page_type string, title string")
    concepts = spark.createDataFrame(CONCEPTS, "kind string, concept string, label string, place int, term string, related boolean")
    wanted = spark.createDataFrame([("product", "Sleutels"), ("product", "slot"), ("product", "SLOTEN"), ("service", "Text"), ("service", "text ")], "kind string, value string")
    specs = page_index.term_specs(concepts, wanted)
    units = page_index.page_units(page_index.page_regions(tree), pages, F.col("path"))
    return specs.collect(), {(r.page_id, r.key): r for r in page_index.page_term_hits(units, pages, specs).collect()}


def test_specs(hits):
    free = [r for r in hits[0] if r.concept is None]
    assert sorted((r.key, r.term) for r in free) == [("product:free:sleutels", "sleutels"), ("service:free:text", "text")]
    assert {r.key for r in hits[0] if r.related} == {"product:locks:related"}


def test_hits(hits):
    h = hits[1]
    locks = h[1, "product:locks"]
    # "slot" is too short for an ending; "sloten" stands in the heading, which runs on into a sentence, and in two sentences
    assert (locks.term, locks.structural, locks.in_nav, locks.sentences, locks["count"], locks.supply) == ("sloten", True, False, 2, 3, False)
    assert h[1, "product:locks:related"].related and h[1, "product:locks:related"].term == "deuren"
    cctv = h[1, "product:cctv"]
    assert cctv.structural and cctv.term == "camera" and cctv["count"] == 2  # "cameras" in the content's heading, the compound
    assert (1, "product:fire") not in h  # in a consent notice and an aside only
    assert h[1, "product:alarm"].in_nav and not h[1, "product:alarm"].structural and h[1, "product:alarm"].quote == "Slotenmaker Jansen"
    schools = h[1, "customer_sector:schools"]
    assert schools.supply and schools.quote.startswith("cameras en sloten wij leveren sloten aan scholen") and schools["count"] == 2
    assert h[1, "customer_sector:care"]["count"] == 1  # not the verb, and within reach of the word of supply
    assert h[1, "role:installer"].structural and not h[1, "role:installer"].in_nav
    assert h[1, "role:maker"]["count"] == 1 and (1, "role:trade") not in h
    assert h[3, "service:free:text"]["count"] == 1 and h[3, "service:free:text"].quote == "plain text"


def test_first_of(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = companies.first_of(rows, ["k"], [F.col("v").desc()], 3, F.col("v")).groupBy("k").agg(companies.in_rank("v").alias("v")).collect()
    assert {r.k: r.v for r in got} == {0: [1998, 1996, 1994], 1: [1999, 1997, 1995]}


def test_hits_without_quotes_and_by_a_shuffle(spark, tree, monkeypatch):
    """Companies' hits need no sentences; a vocabulary too large for every task gives the same hits."""
    pages = spark.createDataFrame([(1, "/sectoren/camera-systemen", "sectors", "Slotenmaker Jansen"), (3, "/x", "other", None), (4, "/sloten", "other", None)], "page_id long, path string, page_type string, title string")
    specs = page_index.term_specs(spark.createDataFrame(CONCEPTS, "kind string, concept string, label string, place int, term string, related boolean"))
    units = page_index.page_units(page_index.page_regions(tree), pages, F.col("path")).cache()
    rows = lambda df: sorted(map(tuple, df.drop("quote").collect()), key=repr)
    whole, bare = page_index.page_term_hits(units, pages, specs), page_index.page_term_hits(units, pages.drop("title"), specs, quotes=False)
    assert rows(whole) == rows(bare) and {r[0] for r in rows(bare)} == {1, 4}  # page 4 has an address only
    monkeypatch.setattr(page_index, "FEW_SPELLINGS", 0)
    assert sorted(map(tuple, page_index.page_term_hits(units, pages, specs).collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_cues_at_once():
    """Looking for all cues at a word's start together finds what each by itself finds."""
    texts = ["wij werken voor de ", "levert aan onder meer ", "xvoor ", "klanten, ", "o.a. grote ", "zoals ", "voor een twee drie vier ", "voor een twee drie vier vijf ", "to the ", "onto ", "", "van onze grote ", "_voor "]
    java = lambda p: re.compile(p.replace(r"\p{L}", "a-zà-ÿ"))
    for pattern, cues in ((page_index.SUPPLY, page_index.SUPPLY_CUES), (page_index.OTHERS, [rf"\b{c}" for c in page_index.OTHERS_CUES])):
        one, together = java(pattern), java(page_index._at_once(pattern, cues))
        assert one.pattern != together.pattern and [bool(one.search(t)) for t in texts] == [bool(together.search(t)) for t in texts]


def test_cue_is_a_word_and_references_end_early(spark):
    """A cue of business stands as a word, not inside a token; a reference without its semicolon is read as a browser reads it."""
    html = "<html><head><title>Sleutel = &quot</title></head><body><h1>Sleutel = &quot</h1><p>token = &quot;fb2b1c&quot; en {} verder</p></body></html>"
    found = {r.page_id: r for r in page_index.page_statements(dom.nodes(spark.createDataFrame([(1, html.format("niets")), (2, html.format("B2B"))], "page_id long, html string"))).collect()}
    assert found[1].business_cues == [] and found[2].business_cues == ["b2b"]
    assert found[1].title == 'Sleutel = "'
