"""Main text of pages: the cut against brute force, pages without telling names, edge cases."""

import itertools
import random
import re

import pytest

from gleaner.llm import html_text

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string"


def stripped(page):
    """The page without names of parts: elements become div, classes go."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main)\b", r"<\1div", page))


def article(page):
    """All text of the article element."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    return " ".join(t for t in map(html_text.clean, html_text.blocks_of(m[0] if m else "")) if t)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit(pages)


def price(label, costs, ties):
    return sum(abs(c) for c, x in zip(costs, label, strict=True) if x != (c > 0)) + sum(w for a, b, w in ties if label[a] != label[b])


def test_minimum_cut_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 7)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        ties = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randint(0, 10))]
        best = min(price(x, costs, ties) for x in itertools.product((False, True), repeat=n))
        assert abs(price(html_text.minimum_cut(costs, ties), costs, ties) - best) < 1e-7


def test_whole_pages_against_brute_force(pages, model):
    """The text of small pages is that of the cheapest of all labellings."""
    rng, tried = random.Random(1), 0
    for r in pages.orderBy("page_id").collect():
        page = stripped(r.html)
        page = page[: rng.randint(300, 1500)]
        blocks = html_text.blocks_of(page)
        if not 1 <= len(blocks) <= 12:
            continue
        texts = [html_text.clean(b) for b in blocks]
        costs = html_text.costs_of(blocks, texts, model).tolist()
        ties = [(a, b, model.ties[d]) for a, b, d in html_text.neighbours(blocks)]
        labels = min(itertools.product((False, True), repeat=len(blocks)), key=lambda x, c=costs, t=ties: price(x, c, t))
        assert html_text.main_text(page, model) == " ".join(t for t, k in zip(texts, labels, strict=True) if k and t)
        tried += 1
    assert tried > 30


def test_pages_without_names_and_what_the_cut_adds(pages, model):
    """Trained on pages that name their parts, right on pages that do not; the cut mends what the blocks alone get wrong."""
    got = pages.collect()
    by_cut = by_sign = differ = 0
    rows = [(r.html, stripped(r.html)) for r in got]
    # a copyright line and a menu of plain text between the paragraphs of an article, which look unlike content by themselves
    rows += [(h, re.sub(r"</p><p>", "</p><p>&copy; 1</p><p>", g, count=1)) for h, g in rows[:100]]
    for h, page in rows:
        blocks = html_text.blocks_of(page)
        texts = [html_text.clean(b) for b in blocks]
        costs = html_text.costs_of(blocks, texts, model)
        sign = [bool(c > 0) for c in costs]
        cut = html_text.minimum_cut(costs.tolist(), [(a, b, model.ties[d]) for a, b, d in html_text.neighbours(blocks)])
        differ += sum(a != b for a, b in zip(sign, cut, strict=True))
        want = article(h if page == stripped(h) else re.sub(r"</p><p>", "</p><p>&copy; 1</p><p>", h, count=1))
        said = lambda keep, texts=texts: " ".join(t for t, k in zip(texts, keep, strict=True) if k and t)
        by_cut += said(cut) == want
        by_sign += said(sign) == want
    assert by_cut >= 0.99 * len(rows) and differ > 0 and by_cut > by_sign
    assert len([w for w in model.weights if abs(w) > 0.1]) >= 6


def misnamed(page, name):
    """The article becomes a part of a misleading class."""
    return re.sub(r"</article>", "</div>", page.replace("<article>", f'<div class="{name}">'))


@pytest.mark.parametrize("name", ["story-share", "post-notice", "related-story", "widget", "comments"])
def test_misleading_names(pages, model, name):
    """On pages whose article has a misleading class the cut is right where the class alone would leave nothing.

    Against the markup alone (a marked block is boilerplate, any other content) the cut decides differently, and better.
    """
    differ = right = by_markup = 0
    rows = pages.orderBy("page_id").collect()
    for r in rows:
        page, want = misnamed(r.html, name), article(r.html)
        blocks = html_text.blocks_of(page)
        texts = [html_text.clean(b) for b in blocks]
        markup = [not b.frame.boiler for b in blocks]
        cut = html_text.minimum_cut(html_text.costs_of(blocks, texts, model).tolist(), [(a, b, model.ties[d]) for a, b, d in html_text.neighbours(blocks)])
        said = lambda keep, texts=texts: " ".join(t for t, k in zip(texts, keep, strict=True) if k and t)
        differ += sum(a != b for a, b in zip(markup, cut, strict=True))
        right += said(cut) == want
        by_markup += said(markup) == want
    assert right >= 0.98 * len(rows) and by_markup < 0.1 * len(rows) and differ > 5 * len(rows)


def test_names_beside_an_article_count(model):
    long = "<p>" + "Readers wrote a great many words here, and all of them at length. " * 20 + "</p>"
    text = "The article has a first sentence, which is long enough. It has a second one, and it is not about readers. Then it ends, as all of them do."
    # beside a part that is only named like content the comments go as well, however long
    assert "Readers" not in html_text.main_text(f"<body><div class='post'><p>{text}</p></div><div id='comment-list'>{long}</div></body>", model)
    for outside in ("<article><p>{0}</p></article><div class='comments'>{1}</div>", "<main><p>{0}</p><section class='comments'>{1}</section></main>"):
        assert html_text.main_text(f"<body>{outside.format(text, long)}</body>", model) == text
    # half of the text is neither all nor little: elements keep their say
    assert html_text.main_text(f"<body><nav>{long}</nav><article><p>Short.</p></article></body>", model) == "Short."


def test_pages_that_name_nothing(spark, pages):
    """A table without a page that names its parts has the model of this module, which is right on these pages."""
    rows = pages.collect()
    bare = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in rows], PAGES)
    assert html_text.fit(bare) == html_text.DEFAULT
    right = sum(html_text.main_text(stripped(r.html)) == article(r.html) for r in rows)
    assert right >= 0.97 * len(rows)


def test_named_parts(model):
    page = """<html><head><title>t</title><script>var x="</p>";</script></head><body><header class="top"><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Tit&eacute;l</h1></header><p>First&nbsp;para <b>bo</b>ld.<p>Second
    line<br>here.<form>mail <input></form><div class="ad">Buy now</div><section id="comments"><p>I liked this very much indeed.</p></section></article>
    <aside>side</aside><footer>&copy; foot</footer></body></html>"""
    for m in (model, html_text.DEFAULT):
        assert html_text.main_text(page, m) == "Titél First para bold. Second line here."
        assert html_text.main_text(None, m) == "" and html_text.main_text("", m) == ""
        assert html_text.main_text("<p>plain words only</p>", m) == "plain words only"
        assert html_text.main_text("<article>" + "<p>word</p>" * 3000 + "</article>", m).count("word") == 3000
        # a name of an outer wrapper does not outweigh an article, a missing end tag of a control drops nothing after its parent
        assert html_text.main_text('<div class="content-sidebar-wrap"><article><p>All of it.</p></article></div>', m) == "All of it."
        assert html_text.main_text("<body><div><button>Go</div><article><p>After the button.</p></article>", m) == "After the button."


def test_query_and_edges(spark, pages, model):
    out = html_text.op8_html_text(spark, SF)
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    got = {r.page_id: r for r in out.collect()}
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    empty = spark.createDataFrame([], PAGES)
    assert html_text.fit(empty) == html_text.DEFAULT
    twice = spark.createDataFrame([(1, "u", "<p>one two</p>"), (1, "u", "<p>one two</p>"), (None, None, None), (2, "u", "x" * 2_000_000)], PAGES)
    texts = [r.t for r in twice.withColumn("page", html_text.F.lit(1)).select(html_text.extract_text(html_text.F.col("html"), model).alias("t")).collect()]
    assert texts[:3] == ["one two", "one two", ""] and len(texts[3]) == 2_000_000
    assert empty.select(html_text.extract_text(html_text.F.col("html")).alias("t")).count() == 0
