"""Input tables, and fact-like rows derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import EMAIL, PHONE, first_match


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as records (the first line is the title): ord, title, company, location, salary, email, phone, posted, source_url, description."""
    d = table(spark, sf_dir, "documents")
    ord_ = F.col("doc_id")
    return d.select(
        ord_.alias("ord"),
        F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit("")).alias("title"),
        F.col("source").alias("company"),
        F.when(ord_ % 7 != 0, F.col("lang")).alias("location"),
        F.when(F.col("n_chars") % 3 == 0, F.col("n_chars").cast("string")).alias("salary"),
        first_match(F.col("text"), EMAIL).alias("email"),
        first_match(F.col("text"), PHONE).alias("phone"),
        F.date_add(F.lit("2024-01-01").cast("date"), (ord_ % 60).cast("int")).alias("posted"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/vacature/"), F.floor(ord_ / 60).cast("string")).alias("source_url"),
        F.when(F.length("text") >= 40, F.col("text")).alias("description"),
        F.col("lang").alias("language"),
    )


#: The same rows for DuckDB, as a common table expression named ``facts``.
FACTS_SQL = r"""
facts AS (
  SELECT doc_id AS ord,
    nullif(trim(split_part(text, chr(10), 1)), '') AS title,
    source AS company,
    CASE WHEN doc_id % 7 <> 0 THEN lang END AS location,
    CASE WHEN n_chars % 3 = 0 THEN CAST(n_chars AS VARCHAR) END AS salary,
    nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email,
    nullif(regexp_extract(text, '\+?[0-9][0-9 ().-]{7,}[0-9]'), '') AS phone,
    DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS posted,
    'https://' || source || '.example.com/vacature/' || CAST(doc_id // 60 AS VARCHAR) AS source_url,
    CASE WHEN length(text) >= 40 THEN text END AS description, lang AS language
  FROM documents)
"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of career and procurement sites, built from parts: ord, url, label, source."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    n = key.cast("string")
    paths = [
        "/", "/vacatures", "/vacatures/senior-data-engineer-{n}", "/jobs/search?q=developer", "/jobs/jobid:{n}", "/position/{n}44", "/n/lead-platform-engineer",
        "/open-sollicitatie", "/contact", "/vacature/categorie/zorg", "/vacatures?page=2", "/careers?vacancy_id=A{n}7", "/aanbestedingen", "/aanbestedingen/levering-van-meubilair-{n}",
        "/inkoop/inkoopbeleid", "/nieuws/tender-voor-groot-onderhoud", "/over-ons/aanbesteding-groot-onderhoud-wegen", "/tenders?page=3", "/leveranciers", "/privacy",
    ]
    pick = F.get(F.array(*(F.lit(x) for x in paths)), (key % len(paths)).cast("int"))
    return p.select(
        key.alias("ord"),
        F.concat(F.lit("https://www.site"), (key % 25).cast("string"), F.lit(".example.nl"), F.replace(pick, F.lit("{n}"), n)).alias("url"),
        F.when(key % 3 == 0, F.lit("Medewerker techniek")).when(key % 3 == 1, F.lit("Aanbesteding wegen noord")).otherwise(F.col("p_type")).alias("label"),
        F.get(F.array(F.lit("link"), F.lit("sitemap"), F.lit("listing")), (key % 4 % 3).cast("int")).alias("source"),
    )


LINKS_SQL = r"""
links AS (
  SELECT p_partkey AS ord,
    'https://www.site' || CAST(p_partkey % 25 AS VARCHAR) || '.example.nl' || replace(([
      '/', '/vacatures', '/vacatures/senior-data-engineer-{n}', '/jobs/search?q=developer', '/jobs/jobid:{n}', '/position/{n}44', '/n/lead-platform-engineer',
      '/open-sollicitatie', '/contact', '/vacature/categorie/zorg', '/vacatures?page=2', '/careers?vacancy_id=A{n}7', '/aanbestedingen', '/aanbestedingen/levering-van-meubilair-{n}',
      '/inkoop/inkoopbeleid', '/nieuws/tender-voor-groot-onderhoud', '/over-ons/aanbesteding-groot-onderhoud-wegen', '/tenders?page=3', '/leveranciers', '/privacy'
    ])[CAST(p_partkey % 20 AS INTEGER) + 1], '{n}', CAST(p_partkey AS VARCHAR)) AS url,
    CASE p_partkey % 3 WHEN 0 THEN 'Medewerker techniek' WHEN 1 THEN 'Aanbesteding wegen noord' ELSE p_type END AS label,
    (['link', 'sitemap', 'listing'])[CAST(p_partkey % 4 % 3 AS INTEGER) + 1] AS source
  FROM part),
routed AS (
  SELECT *, lower(regexp_extract(url, '://[^/]*([^?]*)', 1)) AS path, regexp_extract(url, '\?(.*)$', 1) AS query, lower(trim(label)) AS said FROM links),
segmented AS (
  SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM routed)
"""
