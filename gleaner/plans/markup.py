"""Declared facts and inline items of pages whose markup is built from suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.dom import nodes
from gleaner.functions.sections import declared_facts, page_nodes, section_items
from gleaner.operators import blocks
from gleaner.operators.storage import materialize

from .tables import table


def inline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with up to four procurements in wrapped cards, or as a run of headings, beside a larger group of other cards."""
    k = F.col("s_suppkey")
    key = k.cast("string")
    i = lambda x: x.cast("string")
    said = lambda x: F.concat(F.lit("<p>Kenmerk: K-"), key, F.when(k % 3 != 0, F.concat(F.lit("-"), i(x))).otherwise(F.lit("")), F.lit(".</p><dl><dt>Sluitingsdatum</dt><dd>"), i(x), F.lit(" mei 2026 12:00</dd></dl>"))
    anchor = lambda x: F.when(k % 5 == 0, F.concat(F.lit(' id="a'), i(x), F.lit('"'))).otherwise(F.lit(""))
    card = lambda x: F.concat(F.lit("<div"), anchor(x), F.lit("><div><h3>Levering nummer "), i(x), F.lit("</h3>"), said(x), F.lit("</div></div>"))
    run = lambda x: F.concat(F.lit("<h2>Levering nummer "), i(x), F.lit("</h2>"), said(x))
    numbers = F.sequence(F.lit(1), (k % 4 + 1).cast("int"))
    body = F.when(k % 2 == 0, F.concat(F.lit("<section>"), F.array_join(F.transform(numbers, card), ""), F.lit("</section>"))).otherwise(F.array_join(F.transform(numbers, run), ""))
    cookies = F.lit("<div>" + "".join(f"<div><h4>Cookies {x}</h4><p>Keuze {x}</p></div>" for x in "abcdef") + "</div>")
    pages = table(spark, sf_dir, "supplier").select(k.alias("page_id"), F.concat(F.lit("https://x.nl/"), key).alias("url"), F.concat(F.lit("<body><main>"), cookies, body, F.lit("</main></body>")).alias("html"))
    return section_items(blocks.sections_of(pages))


def declared_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, employers, places and dates that pages declare in various ways."""
    k = F.col("p_partkey")
    pick = lambda n, *xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % n).cast("int"))
    title = pick(4, "<title>Kok - Zaak</title>", "<title>Zaak</title>", "", "<title>Ober | Zaak | Delft</title>")
    semantic = pick(3, '<span itemprop="title">Chef kok</span>', '<span itemprop="title">Zaak</span>', "")
    employer = pick(5, '<div itemprop="hiringOrganization"><b itemprop="name">De  Zaak</b></div>', '<b itemprop="name">Iemand</b>', "", "", "")
    place = pick(2, '<p itemprop="addressLocality">Delft</p><div itemprop="jobLocation"><i itemprop="addressLocality">Gouda</i><i itemprop="addressRegion">Zuid</i></div>', '<p itemprop="streetAddress">Weg 1</p><p itemprop="addressLocality">Delft</p>')
    posted = pick(4, '<meta itemprop="datePosted" content="2026-02-30"><time datetime="2026-03-01T10:00:00">x</time>', '<time itemprop="datePosted" datetime="2026-01-02">x</time>', "", '<time datetime="2026-05-06">x</time>')
    html = F.concat(F.lit('<head><meta property="og:site_name" content="Zaak">'), title, F.lit("</head><body><h1>Zaak</h1><h1>Werken bij ons</h1>"), semantic, employer, place, posted, F.lit("</body>"))
    pages = table(spark, sf_dir, "part").select(k.alias("page_id"), html.alias("html"))
    return declared_facts(page_nodes(pages)).drop("site_name")


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short values near the heading of each page, and what their shape says."""
    tree = materialize(nodes(table(spark, sf_dir, "pages")), "nodes")
    found = blocks.metadata_block(tree, materialize(blocks.page_context(tree), "context"))
    return found.select("page_id", "hours", "contract_type", F.array_join("values", " | ").alias("values"))


def employer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employers on pages built from suppliers: in a heading that the title may confirm, or declared with a logo or without."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    s = table(spark, sf_dir, "supplier").join(n, "s_nationkey")
    c = F.col
    title = F.concat(F.lit("<title>Vacature | "), F.when(c("s_acctbal") > 0, c("s_name")).otherwise(F.lit("Zaak")), F.lit("</title>"))
    author = F.concat(F.lit('<meta name="Author" content="'), F.initcap("n_name"), F.lit('"><meta property="og:site_name" content="'), F.when(c("s_nationkey") < 8, F.lower("n_name")).otherwise(F.lit("Banen")), F.lit('">'))
    logo = F.when(c("s_nationkey") >= 16, F.concat(F.lit('<img alt="Logo van '), F.upper("n_name"), F.lit('">'))).otherwise(F.lit(""))
    named = F.when(c("s_acctbal") > 8000, F.concat(F.lit('<div class="Company-Name big">'), c("s_name"), F.lit(" B.V.</div>"))).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head>"), title, author, F.lit("</head><body>"), logo, F.lit("<h1>Kok</h1><nav><h2>Over Navigatie</h2></nav>"), named, F.lit("<h2>Over ons</h2><section><h3> Over  "), c("s_name"), F.lit(".</h3></section></body></html>"))
    pages = s.select(c("s_suppkey").alias("page_id"), html.alias("html"))
    tree = materialize(nodes(pages), "nodes")
    places = s.select(c("s_suppkey").alias("page_id"), F.when(c("s_acctbal") < 1000, c("s_name")).otherwise(c("n_name")).alias("location"))
    return blocks.employer_blocks(tree, blocks.page_context(tree), places)


QUERIES = {"inline_items": inline_items, "declared_markup": declared_markup, "page_metadata": page_metadata, "employer_blocks": employer_blocks}

ORACLES = {
    "inline_items": """WITH s AS (SELECT s_suppkey AS k, unnest(range(1, s_suppkey % 4 + 2)) AS i FROM supplier WHERE s_suppkey % 4 > 0),
      n AS (SELECT *, 'K-' || k || CASE WHEN k % 3 <> 0 THEN '-' || i ELSE '' END AS ref, k % 5 = 0 AND k % 2 = 0 AS anchored FROM s)
      SELECT k AS page_id, CASE WHEN anchored THEN 'a' || i WHEN k % 3 = 0 AND i > 1 THEN ref || '-' || i ELSE ref END AS item, 'Levering nummer ' || i AS title, ref AS reference,
        '2026-05-0' || i || 'T12:00:00' AS deadline, 'https://x.nl/' || k || CASE WHEN anchored THEN '#a' || i ELSE '' END AS item_url FROM n""",
    "declared_markup": """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'Chef kok' WHEN p_partkey % 4 = 0 THEN 'Kok - Zaak' WHEN p_partkey % 4 = 1 THEN 'Zaak' WHEN p_partkey % 4 = 3 THEN 'Ober | Zaak | Delft' ELSE 'Werken bij ons' END AS title,
      CASE WHEN p_partkey % 5 = 0 THEN 'De Zaak' END AS company, CASE WHEN p_partkey % 2 = 0 THEN 'Gouda, Zuid' ELSE 'Weg 1, Delft' END AS location,
      CASE p_partkey % 4 WHEN 0 THEN DATE '2026-03-01' WHEN 1 THEN DATE '2026-01-02' WHEN 3 THEN DATE '2026-05-06' END AS posted FROM part""",
    "page_metadata": r"""WITH a AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '(?s)<(?:h1|p)>[^<]*</(?:h1|p)>|<br>')[1:100] AS l FROM pages),
      t AS (SELECT page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '&quot;', '"'), '\s+', ' ', 'g'))),
        lambda x: x <> '' AND length(x) <= 40) AS v FROM a)
      SELECT page_id, list_filter(v, lambda x: regexp_matches(lower(x), '^\d{1,3}(?:[.,]\d{1,2})?\s*-?\s*\d{0,3}\s*(?:uur|u|hours?|hrs?)(?:\s*/?\s*(?:per\s*)?(?:week|wk))?$'))[1] AS hours,
        list_filter(v, lambda x: lower(x) IN ('fulltime', 'full-time', 'full time', 'parttime', 'part-time', 'part time', 'voltijd', 'deeltijd'))[1] AS contract_type, array_to_string(v, ' | ') AS "values" FROM t""",
    "employer_blocks": """SELECT s_suppkey AS page_id, CASE WHEN s_acctbal > 8000 THEN s_name || ' B.V.' WHEN s_acctbal >= 1000 THEN s_name END AS block,
      CASE WHEN n_nationkey < 8 OR n_nationkey >= 16 THEN array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS declared
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
}
