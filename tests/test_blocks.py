"""Values near a heading, labels, employers and parts of pages, on literal pages."""

import pytest

from gleaner.functions import employers
from gleaner.functions.dom import nodes
from gleaner.functions.sections import section_items
from gleaner.operators import blocks

VACANCY = """<html><head><title>Tender Manager | Zaak</title><meta property="og:site_name" content="Zaak"></head><body><nav><span>12 uur</span></nav>
<main><div><h1>Zaak</h1><h1>Tender <i>Manager</i></h1></div><ul><li>Hengelo</li><li> 40 uur </li><li>32-36 uur per week</li></ul><p>Over <b>Deeltijd</b></p><div><span>Full-time</span><span>%s</span></div><section><b>24 uur</b></section>
<dl><dt>Werkgever :</dt><p>tussen</p><dd>De <b>Zaak</b></dd><dt>Leeg</dt></dl><table><tr><th>Plaats</th><td>Delft</td></tr></table><p><strong>Uren:</strong> 36 <i>nee</i></p><p><label>Soort</label> : <em>Vast</em></p></main></body></html>""" % ("x" * 41)
CARDS = """<body><nav><h3>Menu</h3></nav><main><div><section id="b"><h4>B</h4></section><section><h4>B2</h4></section></div>
<ul><li id="a1"><div><h3>Levering van stoelen</h3></div><p>Kenmerk: ST-1.</p><a href="/x.pdf?v=1">x</a><a href="/x.pdf?v=1">x</a><a href="/y.docx#a">y</a></li><li><h3>Levering van tafels</h3><dl><dt>Sluitingsdatum</dt><dd>3 mei 2026 12:00</dd></dl></li><li><h3>Algemeen</h3></li><li>niets</li></ul></main></body>"""
RUNS = "<body><div><h2>Werk aan de weg</h2><p>Kenmerk: W-1.</p><h3>Onder</h3><h2>Werk aan de brug</h2><p>Kenmerk: W-2.</p><footer><h2>Voet</h2></footer></div></body>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "u1", VACANCY), (2, "u2", CARDS), (3, "u3", RUNS), (4, "u4", None), (5, "u5", "<h1>Kok</h1><p>38 uur</p>")], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def tree(pages):
    return nodes(pages).cache()


def test_metadata_block(tree):
    context = blocks.page_context(tree)
    assert {r.page_id: (r.site_name, r.page_title) for r in context.collect()}[1] == ("Zaak", "Tender Manager | Zaak")
    got = {r.page_id: r for r in blocks.metadata_block(tree, context).collect()}
    # the heading is none: both h1 repeat the site's name or a part of the title
    assert 1 not in got and got[5].hours is None and got[5]["values"] == []


def test_values_near_a_heading(spark):
    page = VACANCY.replace("<title>Tender Manager | Zaak</title>", "<title>Zaak</title>")
    tree = nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))
    got = blocks.metadata_block(tree, blocks.page_context(tree)).collect()[0]
    # parent of the heading and three elements after it; a part of a longer text counts as an element of its own
    assert got["values"] == ["Zaak", "Manager", "Hengelo", "40 uur", "32-36 uur per week", "Deeltijd", "Full-time"]
    assert (got.hours, got.contract_type) == ("40 uur", "Deeltijd")


def test_label_values(tree):
    got = [(r.label, r.value) for r in blocks.label_values(tree).where("page_id = 1").orderBy("pre").collect()]
    assert got == [("Werkgever", "De Zaak"), ("Plaats", "Delft"), ("Uren", "36"), ("Soort", "Vast")]


def test_sections(pages):
    rows = blocks.sections_of(pages).orderBy("page_id", "grouping", "ord").collect()
    two = [(r.grouping, r.ord, r.heading, r.anchor, r.documents) for r in rows if r.page_id == 2]
    # the list has three parts with a heading, the sections two, and the main element holds both groups
    assert two[:3] == [(0, 0, "Levering van stoelen", "a1", 2), (0, 1, "Levering van tafels", None, 0), (0, 2, "Algemeen", None, 0)]
    assert [t[2] for t in two if t[0] == 1] == ["B", "B2"] and [t[2] for t in two if t[0] == 2] == []
    assert [(p.label, p.value) for r in rows if r.heading == "Levering van tafels" for p in r.pairs] == [("Sluitingsdatum", "3 mei 2026 12:00")]
    three = [(r.grouping, r.heading, r.text) for r in rows if r.page_id == 3]
    assert ("Werk aan de weg", "Werk aan de weg Kenmerk: W-1. Onder") in [t[1:] for t in three]
    items = {(r.page_id, r.item): r.title for r in section_items(blocks.sections_of(pages)).collect()}
    assert items[2, "a1"] == "Levering van stoelen" and (3, "W-1") in items and (3, "W-2") in items


EMPLOYERS = {
    1: ('<div itemprop="employer">Naam: <span itemprop="name"> De  Bank. </span></div><p class="company-name">Anders</p>', None, "De Bank"),
    2: ('<nav><p class="company-name">Menu B.V.</p></nav><p id="EmployerName">Bekijk</p><p class="x employer__name">Acme B.V.</p>', None, "Acme B.V."),
    3: ("<title>Kok bij Van der Valk Hotels</title><h2>Over ons</h2><h3>Over van der Valk Hotels.</h3>", None, "van der Valk Hotels"),
    4: ("<title>Kok in Delft</title><h2>Over Delft</h2>", "Delft", None),
    5: ("<title>Kok</title><h2>Over Acme</h2>", None, None),
    6: ('<meta name="author" content="Jan Jansen"><h1>x</h1>', None, None),
}


def test_employer_blocks(spark):
    rows = [(i, html, place) for i, (html, place, _) in EMPLOYERS.items()]
    rows += [(7, '<meta name="AUTHOR" content="Acme Ltd."><img alt="acme ltd logo">', None), (8, '<meta name="author" content="Zaak"><meta property="og:site_name" content="ZAAK">', None), (9, '<meta name="author" content="Zaak"><img alt="Logo van Zaken">', None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, location string")
    tree = nodes(pages)
    got = {r.page_id: (r.block, r.declared) for r in blocks.employer_blocks(tree, blocks.page_context(tree), pages.select("page_id", "location")).collect()}
    assert {i: got[i][0] for i in EMPLOYERS} == {i: name for i, (_, _, name) in EMPLOYERS.items()}
    assert [got[i][1] for i in (6, 7, 8, 9)] == [None, "Acme Ltd.", "Zaak", None]


NAMES = [
    ("Ministerie van Defensie", True, True, True), ("de Bijenkorf", True, True, True), ("bedrijf zonder naam", True, False, False), ("Acme Ltd. en Zonen", True, False, True), ("Acme.", True, False, True), ("Wij zoeken jou", True, False, False),
    ("Solliciteer nu", False, False, False), ("Wat is dit?", False, False, False), ("x", False, False, False), ("Organisatie en Personeel Rijk (Ministerie van Binnenlandse Zaken en Koninkrijksrelaties) Den Haag", True, False, True), ("Salaris 3000", True, False, False),
]


def test_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n,) for n, *_ in NAMES], "name string").select("name", *(employers.company_name(F.col("name"), s).isNotNull().alias(s) for s in ("explicit", "text", "structured"))).collect()
    assert [tuple(r) for r in rows] == [tuple(n) for n in NAMES]
