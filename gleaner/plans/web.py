"""URLs, links, contacts and candidate ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import url as U
from gleaner.functions.text import EMAIL, PHONE, first_match
from gleaner.operators import matching, ranking

from .tables import LINKS_SQL, links, table

#: Hosts whose search results are not candidates.
EXCLUDED_HOSTS = r"(?:^|\.)(?:google|bing|yahoo|duckduckgo|baidu|yandex|doubleclick|googlesyndication|googleadservices)\.[a-z.]+$|(?:^|\.)search\.brave\.com$"
#: Kinds of hosts that are not the site of a company.
HOST_KINDS = [("directory", "example.org"), ("social", "facebook.com"), ("news", "example.net")]


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", U.normalize_url(F.col("url")).alias("crawl_url"), U.normalize_url(F.col("url"), U.SEARCH_TRACKING).alias("search_url")
    )


def _normal_sql(drop: str) -> str:
    return f"""scheme || '://' || host || path || CASE WHEN len(list_filter(params, lambda x: NOT regexp_matches(split_part(x, '=', 1), '{drop}'))) = 0 THEN ''
      ELSE '?' || array_to_string(list_sort(list_filter(params, lambda x: NOT regexp_matches(split_part(x, '=', 1), '{drop}'))), '&') END"""


_URLS_SQL = r"""
WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
   CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS path,
   list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '') AS params FROM pages)
"""
_CRAWL = "(?i)^(utm_.+|fbclid|gclid)$"
_SEARCH = "(?i)^(utm_.+|fbclid|gclid|msclkid|ref|referrer)$"


def candidate_dedupe_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 60 different candidates: web URLs of hosts that are not search engines, in order of page_id."""
    p = table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url"), U.SEARCH_TRACKING).alias("url"))
    good = p.where("url is not null").where(~F.rlike(U.host(F.col("url")), F.lit(EXCLUDED_HOSTS)))
    first = good.withColumn("n", F.row_number().over(Window.partitionBy(F.lower("url")).orderBy("page_id"))).where("n = 1")
    return first.orderBy("page_id").limit(60).select("page_id", "url")


def registrable_domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("domain", U.registrable_domain(U.host(F.col("url"))))
    return p.groupBy("domain").agg(F.count(F.lit(1)).alias("results"), F.min("page_id").alias("first_page"), F.min_by("url", "page_id").alias("first_url"))


def excluded_host_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of each page's host: by its domain, else by its name, else a candidate."""
    kinds = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(d).alias("kind_domain")) for k, d in HOST_KINDS))))
    p = table(spark, sf_dir, "pages").withColumn("host", U.host(F.col("url")))
    named = F.when(F.rlike("host", F.lit("spam|ads-|casino|pills")), F.lit("advertising"))
    joined = p.withColumn("domain", U.registrable_domain(F.col("host"))).join(F.broadcast(kinds), F.col("domain") == F.col("kind_domain"), "left")  # a fixed list
    return joined.groupBy(F.coalesce("kind", named, F.lit("candidate")).alias("kind")).agg(F.count(F.lit(1)).alias("pages"))


def link_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = links(spark, sf_dir)
    extra = [("vacatures?|vacancy|vacancies|careers?|werken-bij", 1)]
    return l.select("ord", U.link_priority(F.lower(U.path(F.col("url"))), F.lower("label"), extra).alias("priority"))


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from pages to the targets of their links, with how often they stand."""
    p = table(spark, sf_dir, "pages")
    found = p.select("page_id", F.explode(F.expr("""regexp_extract_all(html, '<a href="([^"]*)"', 1)""")).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("ord", F.col("r.score").alias("score"), F.array_join("r.reasons", ",").alias("reasons"), F.col("r.classification").alias("classification"))


def rank_vacancy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = links(spark, sf_dir)
    return _ranked(l.select("ord", ranking.rank_vacancy_link(F.col("url"), F.col("label"), F.col("source")).alias("r")))


def rank_tender_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = links(spark, sf_dir)
    return _ranked(l.select("ord", ranking.rank_tender_link(F.col("url"), F.col("label")).alias("r")))


def rank_company_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = links(spark, sf_dir)
    return _ranked(l.select("ord", ranking.rank_company_link(F.col("url"), F.col("label")).alias("r")))


_VACANCY_SQL = (
    "WITH "
    + LINKS_SQL
    + r""", f AS (SELECT *, coalesce(segs[len(segs)], '') AS last, regexp_matches(query, '(^|&)(q|query|search)=') AS searched,
      regexp_matches(path, '(?:^|/)(?:vacatures?|vacanc(?:y|ies)|jobs?|careers?)(?:/|$)') AS tier,
      regexp_matches(path, '/(?:vacatures?|vacanc(?:y|ies)|jobs?|careers?)/[^/]+') AND NOT regexp_matches(path, '/(?:zoeken|search|categorie|category|categories|overzicht|all|page)(?:/|$)') AS detail,
      (regexp_matches(path, '/jobid:[0-9]{2,}') OR regexp_matches(query, '^vacancy_id=A[0-9]+$')) AS ident,
      regexp_matches(path, '^/position/[0-9]{3,}') AS route, regexp_matches(path, '^/n/[a-z]+-[a-z]+-[a-z]+$') AS slug,
      regexp_matches(said, '\b(?:adviseur|medewerker|manager|engineer|developer|specialist|monteur|coordinator|verpleegkundige|beleidsmedewerker|projectleider|analist|consultant)\b') AS titled,
      regexp_matches(path, '(?:^|[/:_.-])(?:open[-_ ]?sollicitaties?)(?:$|[/:_.?-])') AS opened,
      regexp_matches(path, '(?:^|[/_-])(?:contact|privacy|voorwaarden|terms|nieuws|news|login|account|cookies|inloggen)(?:[/_-]|$)') AS nav,
      regexp_matches(path, '/(?:categorie|category|categories|vakgebieden|organisaties)(?:/|$)') AS cat,
      regexp_matches(query, '(^|&)(page|pagina|offset|start)=') AS paged FROM segmented),
    g AS (SELECT *, NOT ident AND NOT detail AND NOT searched AND route AS by_route, NOT ident AND NOT detail AND NOT searched AND NOT route AND slug AS by_slug FROM f),
    k AS (SELECT *, CASE WHEN detail OR ident OR by_route OR by_slug THEN 'detail' WHEN tier THEN 'listing' WHEN titled THEN 'detail' ELSE 'general' END AS k1 FROM g),
    h AS (SELECT *, k1 = 'detail' AS is_detail, k1 = 'detail' AND opened AS closed FROM k),
    e AS (SELECT *, list_filter([
        CASE WHEN tier THEN {'r': 'vacancy_link_tier', 'p': 20} END, CASE WHEN detail THEN {'r': 'detail_path', 'p': 45} END,
        CASE WHEN ident THEN {'r': 'job_identifier', 'p': CASE WHEN detail THEN 15 ELSE 45 END} END, CASE WHEN by_route THEN {'r': 'record_id_route', 'p': 40} END,
        CASE WHEN by_slug THEN {'r': 'short_detail_route', 'p': 35} END, CASE WHEN titled THEN {'r': 'job_title_anchor', 'p': 25} END,
        CASE WHEN is_detail AND regexp_matches(last, '[a-z].*[-_].*(?:\d{3,}|[a-z])') THEN {'r': 'unique_detail_slug', 'p': 5} END,
        CASE WHEN is_detail AND source = 'sitemap' THEN {'r': 'sitemap_detail', 'p': 10} END, CASE WHEN is_detail AND source = 'listing' THEN {'r': 'listing_detail_link', 'p': 10} END,
        CASE WHEN opened THEN {'r': 'open_application', 'p': -50} END, CASE WHEN path = '/' THEN {'r': 'homepage', 'p': -15} END,
        CASE WHEN nav THEN {'r': 'non_vacancy_navigation', 'p': -90} END, CASE WHEN cat THEN {'r': 'category_overview', 'p': -25} END,
        CASE WHEN searched THEN {'r': 'search_or_filter', 'p': -30} END, CASE WHEN paged THEN {'r': 'pagination', 'p': -20} END], lambda x: x IS NOT NULL) AS s FROM h)
    SELECT ord, CAST(10 + coalesce(list_sum(list_transform(s, lambda x: x.p)), 0) AS INTEGER) AS score, array_to_string(list_transform(s, lambda x: x.r), ',') AS reasons,
      CASE WHEN paged THEN 'pagination' WHEN nav THEN 'general' WHEN closed THEN 'general' ELSE k1 END AS classification FROM e
"""
)

_TENDER_SQL = (
    "WITH "
    + LINKS_SQL
    + r""", w AS (SELECT *, coalesce(segs[len(segs)], '') AS last, list_position(list_transform(segs, lambda s: s IN ('aanbestedingen', 'tenders')), true) AS pos,
      regexp_matches(query, '(^|&)(page|pagina|offset|start|p)=') AS paged, regexp_matches(query, '(^|&)(q|query|search)=') AS searched,
      '(?:aanbested|tender|inkoop|offerte|opdracht|marktconsult|procurement|rfp|rfq|uitvraag|uitvragen|inschrijv)' AS word FROM segmented),
    f AS (SELECT *, coalesce(pos, 0) > 0 AS listed, CASE WHEN coalesce(pos, 0) > 0 THEN segs[pos + 1] END AS item FROM w),
    g AS (SELECT *, coalesce(item IS NOT NULL AND NOT paged AND (regexp_matches(item, '\d{3,}') OR (length(item) >= 8 AND regexp_matches(item, '[a-z]'))), false) AS is_item,
      list_has_any(segs, ['inkoop', 'inkoopbeleid', 'leveranciers', 'contact', 'over-ons']) AS gen FROM f),
    h AS (SELECT *, NOT is_item AND NOT listed AND regexp_matches(last, word) AND len(list_filter(string_split(last, '-'), lambda x: x <> '')) >= 3 AS slug FROM g),
    i AS (SELECT *, NOT is_item AND NOT slug AND regexp_matches(last, '\d{3,}') AND regexp_matches(path, word) AS numbered, regexp_matches(said, word) AND length(said) >= 12 AS texted FROM h),
    k AS (SELECT *, CASE WHEN is_item OR slug OR numbered THEN 'detail' WHEN listed THEN 'listing' WHEN texted THEN 'detail' ELSE 'general' END AS k1,
      regexp_matches(path, '(?:^|[/_-])(?:contact|privacy|voorwaarden|terms|cookies|inloggen|login|account|sitemap|disclaimer|vacatures?|careers?)(?:[/_-]|$)') AS nav FROM i),
    e AS (SELECT *, list_filter([CASE WHEN listed THEN {'r': 'tender_listing_path', 'p': 25} END, CASE WHEN is_item THEN {'r': 'tender_item_path', 'p': 40} END,
        CASE WHEN slug THEN {'r': 'tender_slug', 'p': 35} END, CASE WHEN numbered THEN {'r': 'tender_identifier', 'p': 20} END, CASE WHEN texted THEN {'r': 'tender_link_text', 'p': 20} END,
        CASE WHEN NOT listed AND gen AND k1 = 'general' THEN {'r': 'procurement_information_path', 'p': 15} END, CASE WHEN path = '/' THEN {'r': 'homepage', 'p': -15} END,
        CASE WHEN nav THEN {'r': 'non_tender_navigation', 'p': -90} END, CASE WHEN searched THEN {'r': 'search_or_filter', 'p': -30} END,
        CASE WHEN paged THEN {'r': 'pagination', 'p': -20} END], lambda x: x IS NOT NULL) AS s FROM k)
    SELECT ord, CAST(10 + coalesce(list_sum(list_transform(s, lambda x: x.p)), 0) AS INTEGER) AS score, array_to_string(list_transform(s, lambda x: x.r), ',') AS reasons,
      CASE WHEN paged THEN 'pagination' WHEN nav THEN 'general' ELSE k1 END AS classification FROM e
"""
)


def job_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = links(spark, sf_dir).withColumn("identity", U.job_identity(F.col("url"))).where("identity is not null")
    return l.groupBy("identity").agg(F.min("ord").alias("first_link"), F.count(F.lit(1)).alias("links"))


def text_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First e-mail address and phone number in each text, and how many different addresses there are."""
    d = table(spark, sf_dir, "documents")
    every = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0)), lambda x: F.lower(x)))
    return d.select("doc_id", F.lower(first_match(F.col("text"), EMAIL)).alias("email"), first_match(F.col("text"), PHONE).alias("phone"), F.size(every).alias("addresses")).where("email is not null or phone is not null")


def merge_contacts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and field, the value of the document of lowest priority, the earliest of equals."""
    d = table(spark, sf_dir, "documents")
    rank = F.struct(F.col("doc_id") % 11, "doc_id")
    best = lambda pattern: F.min_by(first_match(F.col("text"), pattern), F.when(first_match(F.col("text"), pattern).isNotNull(), rank))
    return d.groupBy("source").agg(best(EMAIL).alias("email"), best(PHONE).alias("phone"))


def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best links of each site, one of each identity."""
    l = links(spark, sf_dir)
    scored = l.select("ord", U.host(F.col("url")).alias("site"), F.coalesce(U.job_identity(F.col("url")), F.col("url")).alias("identity"), ranking.rank_tender_link(F.col("url"), F.col("label"))["score"].alias("score"))
    return ranking.frontier(scored, "site", "identity", "score", "ord", 10).select("site", "ord", "score", "place")


def request_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's requests at least 3600 s apart."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return ranking.request_slots(e, "user_id", "event_id", "at", 3600).select("event_id", F.col("slot").cast("bigint").alias("slot"))


def host_role_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of each host from its pages' roles and the authorities that they name."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    authority = F.when(n % 3 != 0, F.concat(F.lit("gemeente plaats"), (n % 5).cast("string")))
    role = F.when(n % 4 == 0, F.lit("official_organization_site")).when(n % 9 == 0, F.lit("aggregator")).otherwise(F.lit("unknown_web_source"))
    confidence = F.when(n % 2 == 0, F.lit("high")).otherwise(F.lit("medium"))
    pages = p.select(U.host(F.col("url")).alias("host"), role.alias("role"), confidence.alias("confidence"), F.array_join(matching.name_tokens(authority), " ").alias("authority_key"))
    return matching.host_role(pages)


QUERIES = {
    "url_normalize": url_normalize,
    "candidate_dedupe_cap": candidate_dedupe_cap,
    "registrable_domain_rollup": registrable_domain_rollup,
    "excluded_host_kinds": excluded_host_kinds,
    "link_priority": link_priority,
    "link_graph": link_graph,
    "rank_vacancy_links": rank_vacancy_links,
    "rank_tender_links": rank_tender_links,
    "rank_company_links": rank_company_links,
    "job_identity_keys": job_identity_keys,
    "text_contacts": text_contacts,
    "merge_contacts_by_source": merge_contacts_by_source,
    "frontier_topk": frontier_topk,
    "request_slots": request_slots,
    "host_role_vote": host_role_vote,
}

ORACLES = {
    "url_normalize": _URLS_SQL + f"SELECT page_id, {_normal_sql(_CRAWL)} AS crawl_url, {_normal_sql(_SEARCH)} AS search_url FROM u",
    "candidate_dedupe_cap": _URLS_SQL
    + f""", n AS (SELECT page_id, {_normal_sql(_SEARCH)} AS url FROM u WHERE NOT regexp_matches(host, '{EXCLUDED_HOSTS}')),
      f AS (SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url FROM n GROUP BY lower(url)) SELECT * FROM f ORDER BY page_id LIMIT 60""",
    "registrable_domain_rollup": """WITH h AS (SELECT page_id, url, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www[0-9]?\\.', ''), '.') AS l FROM pages)
      SELECT CASE WHEN len(l) <= 2 THEN array_to_string(l, '.') ELSE l[len(l) - 1] || '.' || l[len(l)] END AS domain, count(*) AS results, min(page_id) AS first_page, arg_min(url, page_id) AS first_url
      FROM h GROUP BY 1""",
    "excluded_host_kinds": """WITH h AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages)
      SELECT CASE WHEN host LIKE '%example.org' THEN 'directory' WHEN host LIKE '%example.net' THEN 'news' WHEN regexp_matches(host, 'spam|ads-|casino|pills') THEN 'advertising' ELSE 'candidate' END AS kind,
        count(*) AS pages FROM h GROUP BY 1""",
    "link_priority": "WITH "
    + LINKS_SQL
    + r"""SELECT ord, CAST(CASE WHEN regexp_matches(t, 'contact(?:-us|ez-nous)?') THEN 0 WHEN regexp_matches(t, 'about|a[-_\s]?propos') THEN 1 WHEN regexp_matches(t, 'reservation|booking|reserver') THEN 2
      WHEN regexp_matches(t, 'vacatures?|vacancy|vacancies|careers?|werken-bij') THEN 1 WHEN regexp_matches(t, 'facilit(?:y|ies)|amenit(?:y|ies)|services?|voorzieningen|equipements?') THEN 4
      WHEN regexp_matches(t, 'tarifs?|prices?|pricing|rates?|prijzen') THEN 5 WHEN regexp_matches(t, 'gallery|galerie|photos?|foto[s]?') THEN 6
      WHEN regexp_matches(t, '\bfaq\b|conditions?|house[-_\s]?rules?|huisregels?|reglement') THEN 7 ELSE 10 END AS INTEGER) AS priority
      FROM (SELECT ord, path || ' ' || lower(label) AS t FROM routed)""",
    "link_graph": """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""",
    "rank_vacancy_links": _VACANCY_SQL,
    "rank_tender_links": _TENDER_SQL,
    "rank_company_links": "WITH "
    + LINKS_SQL
    + r""", k AS (SELECT ord, path, CASE WHEN path = '/' THEN 'home' WHEN regexp_matches(path, '(?:^|[/_-])contact(?:[/_.-]|$)') THEN 'contact' WHEN regexp_matches(path, '(?:^|[/_-])(?:over-ons|over)(?:[/_.-]|$)') THEN 'about' ELSE 'other' END AS kind,
        regexp_matches(path, '(?:^|[/_-])(?:nieuws|vacatures?|careers|jobs|privacy|search)(?:[/_.-]|$)') AS news FROM segmented)
      SELECT ord, CAST(CASE kind WHEN 'home' THEN 5 WHEN 'contact' THEN 55 WHEN 'about' THEN 60 ELSE 15 END - CASE WHEN news THEN 100 ELSE 0 END AS INTEGER) AS score,
        concat_ws(',', kind, CASE WHEN news THEN 'not_company_information' END) AS reasons, 'general' AS classification FROM k""",
    "job_identity_keys": "WITH "
    + LINKS_SQL
    + r""", i AS (SELECT ord, regexp_replace(regexp_extract(url, '^(https://[^/]*)', 1), '://www\.', '://') AS origin, regexp_extract(path, '/jobid:([0-9]+)$', 1) AS j,
        regexp_extract(query, '^vacancy_id=([A-Z0-9]+)$', 1) AS v FROM routed),
      k AS (SELECT ord, CASE WHEN length(v) >= 2 THEN origin || '|vacancyid|' || v WHEN length(j) >= 2 THEN origin || '|jobid|' || j END AS identity FROM i)
      SELECT identity, min(ord) AS first_link, count(*) AS links FROM k WHERE identity IS NOT NULL GROUP BY 1""",
    "text_contacts": r"""WITH c AS (SELECT doc_id, nullif(lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), '') AS email,
        nullif(regexp_extract(text, '\+?[0-9][0-9 ().-]{7,}[0-9]'), '') AS phone,
        CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS INTEGER) AS addresses FROM documents)
      SELECT * FROM c WHERE email IS NOT NULL OR phone IS NOT NULL""",
    "merge_contacts_by_source": r"""WITH c AS (SELECT source, (doc_id % 11) * 1000000000 + doc_id AS r, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email,
        nullif(regexp_extract(text, '\+?[0-9][0-9 ().-]{7,}[0-9]'), '') AS phone FROM documents)
      SELECT source, arg_min(email, r) FILTER (email IS NOT NULL) AS email, arg_min(phone, r) FILTER (phone IS NOT NULL) AS phone FROM c GROUP BY 1""",
    "frontier_topk": _TENDER_SQL.replace("SELECT ord, CAST(10 +", ", ranked AS (SELECT ord, url, path, query, CAST(10 +", 1).replace("classification FROM e", "classification FROM e)", 1)
    + r""", o AS (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS site, regexp_replace(regexp_extract(url, '^(https://[^/]*)', 1), '://www\.', '://') AS origin, regexp_extract(path, '/jobid:([0-9]+)$', 1) AS j,
        regexp_extract(query, '^vacancy_id=([A-Z0-9]+)$', 1) AS v FROM ranked),
      q AS (SELECT *, CASE WHEN length(v) >= 2 THEN origin || '|vacancyid|' || v WHEN length(j) >= 2 THEN origin || '|jobid|' || j ELSE url END AS identity FROM o),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, identity ORDER BY score DESC, ord) AS n FROM q) WHERE n = 1),
      p AS (SELECT site, ord, score, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, ord) AS INTEGER) AS place FROM b)
      SELECT * FROM p WHERE place <= 10""",
    "request_slots": """WITH n AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
      SELECT event_id, CAST(max(t0 - i * 3600) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + i * 3600 AS BIGINT) AS slot FROM n""",
    "host_role_vote": """WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, CASE WHEN page_id % 4 = 0 THEN 'official_organization_site' WHEN page_id % 9 = 0 THEN 'aggregator' ELSE 'unknown_web_source' END AS role,
        CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS c, CASE WHEN page_id % 3 <> 0 THEN page_id % 5 END AS a FROM pages),
      v AS (SELECT host, count(DISTINCT a) AS authorities, min(c) FILTER (role = 'aggregator') AS ag, min(c) FILTER (role = 'official_organization_site') AS o FROM p GROUP BY 1)
      SELECT host, authorities, CASE WHEN authorities >= 3 OR ag IS NOT NULL THEN 'aggregator' WHEN o IS NOT NULL THEN 'official_organization_site' ELSE 'unknown_web_source' END AS role,
        CASE WHEN authorities >= 3 THEN 'high' WHEN ag IS NOT NULL THEN (CASE ag WHEN 0 THEN 'high' ELSE 'medium' END) WHEN o IS NOT NULL THEN (CASE o WHEN 0 THEN 'high' ELSE 'medium' END) ELSE 'low' END AS confidence FROM v""",
}
