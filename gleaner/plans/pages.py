"""Company sites over the pages table: what their pages say of a vocabulary, their activities and how they sell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import url as U
from gleaner.functions.dom import nodes
from gleaner.functions.text import normalize_words
from gleaner.operators import companies as C
from gleaner.operators import page_index as P
from gleaner.operators.profiles import PROFILE, SOURCES, update_profiles
from gleaner.operators.ranking import company_page_type
from gleaner.operators.storage import materialize

from .tables import table


def _kind(item: Column) -> Column:
    return F.element_at(F.array(*(F.lit(k) for k in ("product", "service", "customer_sector", "role"))), (item % 4 + 1).cast("int"))


def vocabulary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Concepts and wanted values read from the benchmark's items: two neighbouring words, one, and a related one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(normalize_words(F.col("text")), " ").alias("w"))
    w = lambda i: F.get("w", F.lit(i))
    of = lambda place, term, related: F.when(term.isNotNull(), F.struct(F.lit(place).alias("place"), term.alias("term"), F.lit(related).alias("related")))
    terms = F.array_compact(F.array(of(0, F.concat(w(0), F.lit(" "), w(1)), False), of(1, F.when(F.length(w(2)) >= 4, w(2)), False), of(2, w(4), True)))
    concepts = b.select(_kind(F.col("item_id")).alias("kind"), F.col("item_id").cast("string").alias("concept"), w(0).alias("label"), F.inline(terms))
    wanted = b.where("item_id % 5 = 0").select(_kind(F.col("item_id")).alias("kind"), w(6).alias("value"))
    return concepts, wanted


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages with host, path and type, and their nodes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("company"), U.path(F.col("url")).alias("path"), "html")
    at = pages.select("page_id", "url", "company", "path", company_page_type(F.col("path")).alias("page_type"))
    return at, nodes(pages)


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(P.term_specs(*vocabulary(spark, sf_dir)), "specs")


def page_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page says of each term key: where, how often, in what context, and the sentence."""
    pages, tree = _pages(spark, sf_dir)
    regions = materialize(P.page_regions(tree), "regions")
    units = materialize(P.page_units(regions, pages, F.col("path")), "units")
    titles = regions.where("region = 'title'").select("page_id", F.col("text").alias("title"))
    return P.page_term_hits(units, pages.join(titles, "page_id", "left"), _specs(spark, sf_dir))


def _company_hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages, and their hits with the page's number as ord, its company and url; written, as several steps read them, without sentences."""
    pages, tree = _pages(spark, sf_dir)
    hits = P.page_term_hits(P.page_units(P.page_regions(tree), pages, F.col("path")), pages, _specs(spark, sf_dir), quotes=False)
    met = hits.join(pages.select("page_id", "company", "url"), "page_id")
    return pages, materialize(met.select("company", "url", F.col("page_id").alias("ord"), "kind", "key", "label", "related", "structural", "sentences", "count", "supply", "term"), "hits")


def site_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of each host from its pages' hits, with strength, the three best pages and the spellings."""
    found = C.activities(_company_hits(spark, sf_dir)[1], "company")
    return found.select("company", "kind", "key", "label", "related", "strength", F.array_join("evidence", " ").alias("evidence"), F.array_join("terms", ",").alias("terms"))


def _profiles(pages: DataFrame, hits: DataFrame, at: str) -> DataFrame:
    """Profiles of hosts from some of their pages: name, activities with evidence, and sources."""
    entry = F.struct(
        "kind", "concept", "label", "related", "strength", F.transform("evidence", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("quote"))).alias("evidence")
    )
    concept = F.when(~F.contains("key", F.lit(":free:")), F.element_at(F.split("key", ":"), 2)).alias("concept")
    # a company's activities are at most so many as the vocabulary has keys
    listed = C.activities(hits, "company").select("company", "kind", "key", concept, "label", "related", "strength", "evidence").groupBy("company").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("key", entry.alias("entry")))), lambda x: x["entry"]).alias("activities")
    )
    names = pages.where("title is not null").groupBy("company").agg(F.min_by("title", "page_id").alias("name"))
    distinct = pages.groupBy("company", "url").agg(F.min("page_id").alias("page_id"))
    first = C.first_of(distinct, ["company"], [F.col("page_id").asc()], SOURCES, F.col("page_id")).withColumn("source", F.struct("url", F.lit(at).alias("checked_at")))
    sources = first.groupBy("company").agg(C.in_rank("source").alias("sources"))
    found = pages.select("company").distinct().join(names, "company", "left").join(listed, "company", "left").join(sources, "company", "left")
    return found.select("company", F.lit(at).alias("checked_at"), *(F.col(c) if c in found.columns else F.lit(None).cast(t).alias(c) for c, t in PROFILE.items()))


def company_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of hosts, stored from two thirds of their pages and updated with what two thirds say, a third of them read again."""
    pages, hits = _company_hits(spark, sf_dir)
    titles = hits.sparkSession.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), "&amp;?", "&")), F.lit("")).alias("title"))
    named = materialize(pages.join(titles, "page_id", "left"), "named")
    part = lambda left_out: (named.where(F.col("page_id") % 3 != left_out), hits.where(F.col("ord") % 3 != left_out))
    found = update_profiles(materialize(_profiles(*part(2), "first"), "profiles"), materialize(_profiles(*part(0), "second"), "profiles"))
    said = F.array_sort(F.transform("activities", lambda a: F.concat_ws(" ", a["kind"], F.coalesce(a["concept"], F.lit("free")), a["label"], a["related"].cast("string"), a["strength"], F.array_join(F.transform(a["evidence"], lambda e: e["url"]), " "))))
    return found.select(
        "company", "name", F.array_join(said, " | ").alias("activities"), F.size("sources").alias("sources"), F.array_join(F.transform("changes", lambda c: F.concat_ws(" -> ", c["previous"], c["current"])), ";").alias("changes"), "changed", "is_new"
    )


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as their base makes them, each also from the folder above, with dots, and without a scheme.

    To the links that stand on a page come three forms of each, made of its text; every second page has a base element.
    """
    c = F.col
    p = table(spark, sf_dir, "pages")
    more = """<a href="/$1"></a><a href=../$1></a><a href="./x/../$1?b=2&amp;a=1#f"></a><A HREF='//other.example.org/a/../$1'>"""
    forms = F.regexp_replace("html", '<a href="/([^"]*)">', more)
    base = F.when(c("page_id") % 2 == 0, F.lit('<base href="/base/of/pages">')).otherwise(F.lit(""))
    made = p.select("page_id", "url", F.concat(base, forms).alias("html"))
    found = P.page_links(materialize(nodes(made), "nodes"), made, lambda target, label: F.endswith(target, F.lit("e")))
    return found.groupBy("page_id", "target", "source").agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))


def page_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page declares and how it sells."""
    tree = materialize(_pages(spark, sf_dir)[1], "nodes")
    return P.page_statements(tree).withColumns({c: F.array_join(c, ",") for c in ("consumer_cues", "business_cues")})


#: The pages' parts for DuckDB: title, heading, menu links, content and footer of the given tables' markup.
_PARTS = r"""
raw AS (SELECT page_id, url, coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS company,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
cutout AS (SELECT page_id, 'title' AS region, 0 AS unit, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS x FROM raw
  UNION ALL SELECT page_id, 'heading', 1, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) FROM raw
  UNION ALL SELECT page_id, 'content', 0, regexp_extract(h, '(?s)</nav>(.*)<footer>', 1) FROM raw
  UNION ALL SELECT page_id, 'footer', 0, regexp_extract(h, '(?s)<footer>(.*)', 1) FROM raw
  UNION ALL SELECT page_id, 'nav', i, l[i] FROM (SELECT page_id, unnest(range(1, len(l) + 1)) AS i, l FROM (
    SELECT page_id, regexp_extract_all(regexp_extract(h, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1) AS l FROM raw)) WHERE i <= 150),
parts AS (SELECT page_id, region, unit, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g'),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '\s+', ' ', 'g')) AS t FROM cutout)"""

_HITS = (
    r"""items AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w,
    (['product', 'service', 'customer_sector', 'role'])[CAST(item_id % 4 AS INTEGER) + 1] AS kind FROM benchmark),
concepts AS (SELECT kind, CAST(item_id AS VARCHAR) AS concept, w[1] AS label, 0 AS place, w[1] || ' ' || w[2] AS term, false AS related FROM items WHERE len(w) >= 2
  UNION ALL SELECT kind, CAST(item_id AS VARCHAR), w[1], 1, w[3], false FROM items WHERE length(w[3]) >= 4
  UNION ALL SELECT kind, CAST(item_id AS VARCHAR), w[1], 2, w[5], true FROM items WHERE len(w) >= 5),
folded AS (SELECT *, strip_accents(term) AS norm FROM concepts),
named AS (SELECT kind, norm FROM folded WHERE NOT related UNION SELECT kind, strip_accents(label) FROM folded WHERE NOT related),
specs AS (SELECT kind || ':' || concept || CASE WHEN related THEN ':related' ELSE '' END AS key, kind, concept, label, related, place, norm AS term FROM folded
  UNION ALL SELECT kind || ':free:' || norm, kind, NULL, label, false, 0, norm FROM (
    SELECT kind, strip_accents(w[7]) AS norm, min(w[7]) AS label FROM items WHERE item_id % 5 = 0 AND len(w) >= 7 GROUP BY 1, 2) ANTI JOIN named USING (kind, norm)),
pieces AS (SELECT page_id, region, unit, t FROM parts WHERE region IN ('title', 'heading', 'nav')
  UNION ALL SELECT page_id, region, i, s[i] FROM (SELECT page_id, region, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT page_id, region, flatten(list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(t, '([.!?;]) +', '\1' || chr(1), 'g'), ' [•·|] ', chr(1), 'g'), chr(1)),
      lambda x: trim(x)), lambda x: length(x) >= 3), lambda x: list_transform(range(0, length(x), 400), lambda k: substr(x, k + 1, 400)))) AS s FROM parts WHERE region = 'content'))
  UNION ALL SELECT page_id, 'slug', 0, regexp_replace(path, '[-_/.]+', ' ', 'g') FROM raw),
units AS (SELECT page_id, CASE region WHEN 'title' THEN 'heading' ELSE region END AS region, unit,
    trim(regexp_replace(translate(strip_accents(lower(t)), '‘’´`‐‑‒–—―', chr(39) || chr(39) || chr(39) || chr(39) || '------'), '\s+', ' ', 'g')) AS t FROM pieces),
toks AS (SELECT page_id, region, unit, t, regexp_extract_all(t, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS k FROM units WHERE t <> ''),
spots AS (SELECT page_id, region, unit, t, k, unnest(range(1, len(k) + 1)) AS i FROM toks),
words AS (SELECT * FROM spots WHERE regexp_matches(k[i], '^[\p{L}\p{N}]')),
runs AS (SELECT page_id, region, unit, t, k, i, 1 AS size, k[i] AS run FROM words
  UNION ALL SELECT page_id, region, unit, t, k, i, 2, k[i] || ' ' || k[i + 2] FROM words WHERE regexp_matches(k[i + 1], '^[\s-]+$') AND k[i + 2] IS NOT NULL),
terms AS (SELECT DISTINCT term FROM specs),
spelled AS (SELECT term, term || unnest(CASE WHEN length(term) >= 5 THEN ['', 's', 'en', 'es', 'n'] ELSE [''] END) AS run FROM terms WHERE length(term) < 8 OR contains(term, ' ')),
met AS (SELECT r.*, s.term FROM runs r JOIN spelled s USING (run)
  UNION ALL SELECT r.*, s.term FROM runs r JOIN terms s ON r.size = 1 AND length(s.term) >= 8 AND NOT contains(s.term, ' ') AND starts_with(r.run, s.term)
    AND regexp_matches(substr(r.run, length(s.term) + 1), '^\p{L}*$')),
placed AS (SELECT m.*, s.key, s.kind, s.place, right(array_to_string(k[1:i - 1], ''), 60) AS b FROM met m JOIN (SELECT key, kind, term, min(place) AS place FROM specs GROUP BY ALL) s USING (term)),
cued AS (SELECT *, kind = 'role' AND regexp_matches(b, '{others}') AS others, regexp_matches(b, '{supply}') AS cue,
    row_number() OVER (PARTITION BY page_id, key, region, term ORDER BY unit, i) AS n FROM placed),
counted AS (SELECT * FROM cued WHERE NOT others AND (region = 'content' OR n = 1) AND (region <> 'slug' OR kind <> 'role')),
said AS (SELECT page_id, key, kind, bool_or(region IN ('heading', 'slug')) AS structural, bool_or(region = 'nav') AS in_nav,
    count(DISTINCT unit) FILTER (region = 'content') AS sentences, count(*) FILTER (region = 'content') AS "count", coalesce(bool_or(cue) FILTER (region = 'content'), false) AS supplied, arg_min(term, place) AS term,
    arg_min(t, (place, unit, i)) FILTER (region = 'content') AS q1, arg_min(t, (place, unit, i)) FILTER (region = 'content' AND cue) AS q2 FROM counted GROUP BY 1, 2, 3),
labels AS (SELECT key, arg_min(concept, place) AS concept, arg_min(label, place) AS label, arg_min(related, place) AS related FROM specs GROUP BY key),
hits AS (SELECT page_id, kind, key, concept, label, related, structural, in_nav, sentences, "count",
    kind = 'customer_sector' AND (supplied OR (structural AND regexp_matches(lower(path), '(?:^|[/_-])(?:projecten|project|referenties|referentie|cases|case|portfolio|sectoren|sector|markten|markt|branches|branche)(?:[/_.-]|$)'))) AS supply, term,
    substr(coalesce(CASE WHEN kind = 'customer_sector' THEN q2 END, q1, substr(nullif(p.t, ''), 1, 200), ''), 1, 280) AS quote
  FROM said JOIN labels USING (key) JOIN raw USING (page_id) LEFT JOIN (SELECT page_id, t FROM parts WHERE region = 'title') p USING (page_id))"""
).replace("{others}", P.OTHERS.replace("'", "''")).replace("{supply}", P.SUPPLY.replace("'", "''"))

ORACLES = {
    "page_term_hits": f"WITH {_PARTS}, {_HITS} SELECT * FROM hits",
    "site_activities": f"""WITH {_PARTS}, {_HITS}, own AS (SELECT h.*, company, url FROM hits h JOIN raw USING (page_id)),
spelt AS (SELECT company, kind, key, term, min(page_id) AS o FROM own GROUP BY ALL)
SELECT company, kind, key, arg_min(label, page_id) AS label, arg_min(related, page_id) AS related,
  CASE WHEN NOT bool_or(related) AND (CASE WHEN kind = 'customer_sector' THEN bool_or(supply) ELSE bool_or(structural) OR sum(sentences) >= 2 END) THEN 'strong' ELSE 'weak' END AS strength,
  array_to_string((list(url ORDER BY supply DESC, structural DESC, "count" DESC, page_id))[1:3], ' ') AS evidence, max(ts) AS terms
FROM own JOIN (SELECT company, kind, key, array_to_string((list(term ORDER BY o, term))[1:5], ',') AS ts FROM spelt GROUP BY ALL) USING (company, kind, key) GROUP BY company, kind, key""",
    "company_update": f"""WITH {_PARTS}, {_HITS}, titled AS (SELECT r.page_id, company, r.url, nullif(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;?', '&', 'g')), '') AS title
    FROM raw r JOIN pages USING (page_id)),
sides AS (SELECT * FROM (VALUES ('s', 2), ('n', 0)) v(side, gap)),
own AS (SELECT side, h.*, company, url FROM hits h JOIN raw USING (page_id) JOIN sides ON page_id % 3 <> gap),
acts AS (SELECT side, company, kind, key, arg_min(label, page_id) AS label, arg_min(concept, page_id) AS concept, arg_min(related, page_id) AS related,
  CASE WHEN NOT bool_or(related) AND (CASE WHEN kind = 'customer_sector' THEN bool_or(supply) ELSE bool_or(structural) OR sum(sentences) >= 2 END) THEN 'strong' ELSE 'weak' END AS strength,
  (list(url ORDER BY supply DESC, structural DESC, "count" DESC, page_id))[1:3] AS ev FROM own GROUP BY side, company, kind, key),
a AS (SELECT * FROM acts WHERE side = 's'), b AS (SELECT * FROM acts WHERE side = 'n'),
m AS (SELECT coalesce(a.company, b.company) AS company, coalesce(a.kind, b.kind) AS kind, coalesce(a.concept, b.concept, 'free') AS concept, coalesce(a.label, b.label) AS label, coalesce(a.related, b.related) AS related,
    CASE WHEN a.key IS NULL THEN b.strength WHEN b.key IS NULL THEN a.strength WHEN b.strength = 'strong' OR len(list_filter(a.ev, lambda u: NOT list_contains(b.ev, u))) = 0 THEN b.strength ELSE a.strength END AS strength,
    CASE WHEN a.key IS NULL THEN b.ev WHEN b.key IS NULL THEN a.ev ELSE list_concat(a.ev, list_filter(b.ev, lambda u: NOT list_contains(a.ev, u)))[1:5] END AS ev, a.key IS NOT NULL AS had, a.strength AS was, a.ev AS ev_was
  FROM a FULL JOIN b ON a.company = b.company AND a.key = b.key),
listed AS (SELECT company, array_to_string(list_sort(list(kind || ' ' || concept || ' ' || label || ' ' || CAST(related AS VARCHAR) || ' ' || strength || ' ' || array_to_string(ev, ' '))), ' | ') AS activities,
    bool_or(NOT had OR was <> strength OR ev <> ev_was) AS news FROM m GROUP BY company),
p AS (SELECT side, company, arg_min(title, page_id) FILTER (title IS NOT NULL) AS name, list_distinct(list(url)) AS urls FROM titled JOIN sides ON page_id % 3 <> gap GROUP BY side, company),
j AS (SELECT coalesce(x.company, y.company) AS company, x.name AS old, y.name AS new, x.company IS NOT NULL AS had, y.company IS NOT NULL AS found,
    len(list_distinct(list_concat(coalesce(x.urls, []), coalesce(y.urls, [])))) AS n, len(coalesce(x.urls, [])) AS n_old
  FROM (SELECT * FROM p WHERE side = 's') x FULL JOIN (SELECT * FROM p WHERE side = 'n') y ON x.company = y.company)
SELECT company, coalesce(new, old) AS name, coalesce(activities, '') AS activities, least(n, 60) AS sources, CASE WHEN had AND old <> new THEN old || ' -> ' || new ELSE '' END AS changes,
  CASE WHEN had AND found THEN coalesce(old <> new, old IS NULL AND new IS NOT NULL) OR coalesce(news, false) OR (n > n_old AND n_old < 60) ELSE found END AS changed, NOT had AS is_new FROM j LEFT JOIN listed USING (company)""",
    "resolved_links": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    CASE WHEN page_id % 2 = 0 THEN '/base/of/pages' ELSE coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') END AS path, html FROM pages),
f AS (SELECT page_id, scheme, host, regexp_extract(path, '^(.*/)', 1) AS dir, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS t, unnest(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1)) AS said FROM p),
u AS (SELECT page_id, scheme || '//' || host || '/' || t AS target, '' AS label FROM f
  UNION ALL SELECT page_id, scheme || '//' || host || regexp_replace(dir, '[^/]+/$', '') || t, '' FROM f
  UNION ALL SELECT page_id, scheme || '//' || host || dir || t || '?a=1&b=2', '' FROM f
  UNION ALL SELECT page_id, scheme || '//other.example.org/' || t, trim(said) FROM f)
SELECT page_id, target, CASE WHEN (SELECT count(*) FROM u v WHERE v.page_id = u.page_id AND ends_with(v.target, 'e')) >= 3 THEN 'listing' ELSE 'link' END AS source, count(*) AS n, max(label) AS label FROM u GROUP BY page_id, target""",
    "page_statements": rf"""WITH {_PARTS}, t AS (SELECT page_id, max(t) FILTER (region = 'title') AS title, max(t) FILTER (region = 'content') AS content, max(t) FILTER (region = 'footer') AS foot,
    coalesce(string_agg(t, ' ' ORDER BY unit) FILTER (region = 'nav'), '') AS nav FROM parts GROUP BY page_id)
SELECT page_id, nullif(title, '') AS title, NULL::VARCHAR AS description, NULL::VARCHAR AS site_name,
  nullif(regexp_extract(foot, '©\s*(?:\d{{4}}\s*)?([A-Z0-9][\p{{L}}\p{{N}}&''. -]{{1,60}}?\s(?:B\.?V\.?|N\.?V\.?))', 1), '') AS legal_name,
  nullif(regexp_extract(lower(content), '(?:kvk|kamer van koophandel)\D{{0,12}}(\d{{8}})', 1), '') AS registration,
  regexp_matches(lower(nav), 'winkelwagen|winkelmand|add to cart|shopping cart|afrekenen') AS cart,
  least(len(regexp_extract_all(content, '€ ?\d{{1,5}}')), 50) AS prices, false AS product_data,
  array_to_string(list_distinct(regexp_extract_all(lower(content), 'particulieren|consumenten|op voorraad')), ',') AS consumer_cues,
  array_to_string(list_distinct(regexp_extract_all(lower(content), 'dealers?|vakhandel|groothandel|opdrachtgevers|b2b')), ',') AS business_cues,
  length(trim(regexp_replace(nav || ' ' || content || ' ' || foot, '\s+', ' ', 'g'))) AS n_chars FROM t""",
}

QUERIES = {f.__name__: f for f in (page_term_hits, site_activities, page_statements, resolved_links, company_update)}
