"""Sitemaps, robots rules, streams and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import url as U
from gleaner.functions.assess import assess_pages
from gleaner.functions.page import page_facts
from gleaner.operators.storage import new_path
from gleaner.sources import feeds
from gleaner.streaming.changes import changes

from .tables import table

#: Sitemaps of a language, and pages in a part of one; the reader takes up to 50,000 locations a part.
FILES, PART_PAGES = 7, 1000


def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations of sitemaps built from page URLs by language.

    What is one file to the reader is built in parts of at most ``PART_PAGES`` pages, each numbered on from
    the pages before it, so no part meets the limit of locations. A part holds a range of page_ids, and ranges
    are counted first: no group of pages grows with the table, only the numbers of pages (one a range) do.
    """
    p = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1).alias("lang"), "url")
    span = F.coalesce(F.floor(F.col("page_id") / (FILES * PART_PAGES)), F.lit((1 << 63) - 1))  # no page_id: last
    p = p.withColumns({"file": F.concat_ws("-", "lang", (F.col("page_id") % FILES).cast("string")), "span": span})
    before = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    starts = p.groupBy("file", "span").count().select("file", "span", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    # repeated page_ids may fill a range with more than one part
    at = F.row_number().over(Window.partitionBy("file", "span").orderBy("page_id", "url")) - 1
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    parts = p.withColumn("at", at).withColumn("part", F.floor(F.col("at") / PART_PAGES)).groupBy("file", "span", "part").agg(
        F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", loc.alias("l")))), lambda x: x["l"]), ""), F.lit("</urlset>")).alias("body")
    )
    first = (F.col("start") + F.col("part") * PART_PAGES).cast("int").alias("first")
    files = parts.join(starts, ["file", "span"]).select(F.struct("file", first).alias("origin"), "body")
    return feeds.sitemap_locations(files, "origin", "body").select("origin.file", (F.col("origin.first") + F.col("ord")).alias("ord"), "location")


def robots_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages may be fetched: every fifth host has no robots file, every seventh fails, the others have rules, read once a host."""
    p = table(spark, sf_dir, "pages").where(F.col("url").isNotNull()).select("page_id", U.host(F.col("url")).alias("host"), F.regexp_extract("url", "://[^/?#]*([^#]*)", 1).alias("path"))
    n = F.length("host")
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: x\nUser-agent: *  # all\nDisallow: /en/\nAllow: /en/1*.html$\nDisallow: /de/1\nDisallow:\n")
    origins = p.select("host").distinct().select("host", F.when(n % 5 == 0, 404).when(n % 7 == 0, 503).otherwise(200).alias("status"), body.alias("body"))
    rules = feeds.robots_rules(origins, "host", "status", "body")
    return p.join(rules, "host").select("page_id", feeds.robots_allow(F.col("rules"), F.col("path")).alias("allowed"))


def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of part keys, and a few written long, by whether a crawler may connect to them."""
    k = F.col("p_partkey")
    made = F.concat_ws(".", *(((k * m) % 256).cast("string") for m in (7, 31, 3, 1)))
    other = F.get(F.array(*(F.lit(x) for x in ("::1", "fe80::1", "2a00:1450:4001::8", "10.0.0.1", "300.1.1.1", "::ffff:8.8.8.8", "::ffff:10.1.1.1", "name", ""))), (k % 9).cast("int"))
    address = F.when(k % 3 == 0, other).otherwise(made)
    return table(spark, sf_dir, "part").select("p_partkey", feeds.public_address(address).alias("public"))


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents in a row are versions of one item; they come as a stream, and each is compared with the one before."""
    out, log = new_path(spark, "changes"), new_path(spark, "changes-log")
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")
    found = changes(docs.withColumn("item", F.floor(F.col("doc_id") / 4)), "item", "text", "doc_id")
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select(F.col("ord").alias("doc_id"), "state")


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, headings, contacts and links of every page."""
    return page_facts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def page_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page is one tender or one vacancy."""
    return assess_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    "sitemap_links": sitemap_links,
    "robots_verdicts": robots_verdicts,
    "public_addresses": public_addresses,
    "change_stream": change_stream,
    "page_extract": page_extract,
    "page_assessment": page_assessment,
}

ORACLES = {
    "sitemap_links": """WITH p AS (SELECT page_id, url, concat_ws('-', regexp_extract(url, '://[^/]*/([a-z]{2})/', 1), CAST(page_id % 7 AS VARCHAR)) AS file FROM pages)
      SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY page_id) - 1 AS INTEGER) AS ord, url AS location FROM p""",
    "robots_verdicts": r"""WITH p AS (SELECT page_id, length(lower(regexp_extract(url, '://([^/?#:]*)', 1))) AS n, regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)
      SELECT page_id, CASE WHEN n % 5 = 0 THEN true WHEN n % 7 = 0 THEN NOT starts_with(path, '/') ELSE regexp_matches(path, '^/en/1.*\.html$') OR NOT regexp_matches(path, '^/(en/|de/1)') END AS allowed FROM p""",
    "public_addresses": """WITH a AS (SELECT p_partkey, p_partkey * 7 % 256 AS a, p_partkey * 31 % 256 AS b, p_partkey * 3 % 256 AS c FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 9 = 6 AND false OR p_partkey % 9 IN (2, 5) ELSE NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
        OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) END AS public FROM a""",
    "change_stream": """SELECT doc_id, CASE WHEN b IS NULL THEN 'new' WHEN b IS NOT DISTINCT FROM text THEN 'unchanged' ELSE 'changed' END AS state
      FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) AS b FROM documents)""",
}
