"""Contacts, evidence, change logs and counts over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import evidence as E
from gleaner.operators import matching

from .tables import table


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five contact fields of sites from their pages."""
    n = F.col("o_orderkey")
    some = lambda k, text: F.when(n % k == 0, F.concat(F.lit(text), n.cast("string")))
    pages = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 60).alias("site"), n.alias("ord"), _pick(n % 5, "/x", "/contact", "/about-us", "/booking", "/faq").alias("path"), some(7, "mail").alias("email"), some(3, "tel").alias("phone"),
        some(31, "wa").alias("whatsapp"), F.when(n % 4 == 0, F.lit("")).alias("instagram"), some(11, "fb").alias("facebook"),
    )
    return E.merge_contacts(pages, "site", F.col("path"), "ord")


def best_evidence_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.max("l_quantity").alias("score"))
    return E.best_evidence(l, "l_partkey", "score", "l_orderkey")


def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stored and as they come in again, with a field unknown, one the same and one changed."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    stored = s.select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.when(k % 3 != 0, F.lit("a")).alias("phone"))
    incoming = s.select("s_suppkey", F.when(k % 2 == 0, F.col("s_name")).alias("name"), (F.col("s_nationkey") + (k % 4 == 0).cast("int")).alias("nation"), F.lit("b").alias("phone"))
    return E.change_log(stored, incoming, "s_suppkey", ["name", "nation", "phone"])


def distinct_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    tokens = F.split(_pick(n % 4, "GV-1,GV-1Procedure,GV-2", "A,B,A", "X-12,X-1", "only"), ",")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(E.distinct_tokens(tokens), ",").alias("references"))


def rejection_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_type", F.when(n % 3 != 0, _pick(n % 4, "no_title", "overview_page", "no_deadline", "no_title")).alias("reason"), (n % 2).alias("source"))
    found = E.counts_by_value(rows, "event_type", ["reason", "source"])
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias(m)
    return found.select("event_type", flat("reason"), flat("source"))


def sitemap_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    children = table(spark, sf_dir, "part").select((n % 9).alias("index"), n.alias("ord"), F.concat(F.lit("https://x.nl/"), _pick(n % 4, "blog", "vacatures", "pages", "events"), n.cast("string"), F.lit(".xml")).alias("location"))
    return E.children_to_read(children, "index", "location", "ord", "vacatures?|jobs?").select("index", "ord", "place")


def crawlable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    url = _pick(n % 8, "https://x.nl/a", "HTTP://X.NL/b.html?x=1.pdf", "https://u:p@x.nl/", "ftp://x.nl/", "https://x.nl/f.PDF#p", "https://www.x.nl/", "https://x.nl:8443/", "mailto:a@x.nl")
    return table(spark, sf_dir, "part").select("p_partkey", E.allowed_page(url, F.lit("x.nl")).alias("allowed"))


def source_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose site a page is on, from the names that it states."""
    n = F.col("p_partkey")
    none = F.lit(None).cast("string")
    authority = F.when(n % 3 == 0, F.lit("gemeente hunze en aas")).when(n % 3 == 1, F.lit("provincie drenthe")).otherwise(none)
    publisher = _pick(n % 4, "waterschap hunze en aas", "gemeente hunze en aas", "tenderplein", None)
    role = matching.page_role(authority, publisher, none, _pick(n % 2, "www.hunzeenaas.nl", "example.com"), n % 5 == 0, n % 7 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", role["role"].alias("role"), role["confidence"].alias("confidence"))


QUERIES = {
    f.__name__: f for f in (site_contacts, best_evidence_by_url, record_changes, distinct_references, rejection_histograms, sitemap_children, crawlable_links, source_roles)
}

ORACLES = {
    "site_contacts": """WITH p AS (SELECT o_custkey % 60 AS site, CAST((['10', '00', '01', '02', '07'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS BIGINT) * 100000000000 + o_orderkey AS r, o_orderkey AS n FROM orders)
      SELECT site, arg_min('mail' || n, r) FILTER (n % 7 = 0) AS email, arg_min('tel' || n, r) FILTER (n % 3 = 0) AS phone, arg_min('wa' || n, r) FILTER (n % 31 = 0) AS whatsapp, CAST(NULL AS VARCHAR) AS instagram,
        arg_min('fb' || n, r) FILTER (n % 11 = 0) AS facebook FROM p GROUP BY 1""",
    "best_evidence_by_url": """WITH g AS (SELECT l_partkey, l_orderkey, max(l_quantity) AS score FROM lineitem GROUP BY 1, 2)
      SELECT l_partkey, l_orderkey, score FROM g QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_orderkey) = 1""",
    "record_changes": """SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS VARCHAR) AS before, CAST(s_nationkey + 1 AS VARCHAR) AS after FROM supplier WHERE s_suppkey % 4 = 0
      UNION ALL SELECT s_suppkey, 'phone', CASE WHEN s_suppkey % 3 <> 0 THEN 'a' END, 'b' FROM supplier""",
    "distinct_references": """SELECT p_partkey, (['GV-1,GV-2', 'A,B', 'X-1', 'only'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS "references" FROM part""",
    "rejection_histograms": """WITH e AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 THEN (['no_title', 'overview_page', 'no_deadline', 'no_title'])[CAST(event_id % 4 AS INTEGER) + 1] END AS reason, event_id % 2 AS source FROM events),
      r AS (SELECT event_type, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reason FROM (SELECT event_type, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT event_type, string_agg(source || '=' || n, ',' ORDER BY source) AS source FROM (SELECT event_type, source, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1) SELECT event_type, reason, source FROM r FULL JOIN s USING (event_type)""",
    "sitemap_children": """WITH c AS (SELECT p_partkey % 9 AS "index", p_partkey AS ord, row_number() OVER (PARTITION BY p_partkey % 9 ORDER BY p_partkey) AS n FROM part)
      SELECT "index", ord, CAST(row_number() OVER (PARTITION BY "index" ORDER BY CASE WHEN ord % 4 = 1 THEN 0 ELSE 1 END, n) AS INTEGER) AS place FROM c WHERE n <= 10""",
    "crawlable_links": "SELECT p_partkey, p_partkey % 8 < 2 AS allowed FROM part",
    "source_roles": """WITH n AS (SELECT p_partkey AS k, k % 3 AS a, k % 4 AS p, k % 2 = 0 AS own, k % 5 = 0 AS plat, k % 7 = 0 AS we FROM part),
      s AS (SELECT *, a < 2 AND p < 3 AS stated, a = 0 AND p IN (0, 1) AS same FROM n),
      g AS (SELECT *, CASE WHEN stated AND NOT same THEN 2 ELSE 0 END + CASE WHEN plat THEN 2 ELSE 0 END + CASE WHEN p = 2 THEN 2 ELSE 0 END AS ag FROM s),
      o AS (SELECT *, CASE WHEN same THEN 3 ELSE 0 END + CASE WHEN ag = 0 THEN CASE WHEN own AND p IN (0, 1) THEN 1 ELSE 0 END + CASE WHEN we THEN 1 ELSE 0 END ELSE 0 END AS f FROM g)
      SELECT k AS p_partkey, CASE WHEN ag >= 2 AND ag > f THEN 'aggregator' WHEN f >= 2 AND ag = 0 THEN 'official_organization_site' ELSE 'unknown_web_source' END AS role,
        CASE WHEN ag >= 2 AND ag > f THEN CASE WHEN ag >= 4 THEN 'high' ELSE 'medium' END WHEN f >= 2 AND ag = 0 THEN CASE WHEN f >= 3 THEN 'high' ELSE 'medium' END ELSE 'low' END AS confidence FROM o""",
}
