"""Notices of two publishers mapped to tender facts, and what a page says of country and identity.

The notices are JSON texts built from ``orders``; the SQL says what each of them must give, from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import notices as N

from .tables import table


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def notice_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, json): one notice for each order, with fields missing, in several languages and of unexpected types."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    n = k.cast("string")
    none = F.lit(None).cast("string")
    text = lambda *parts: F.concat(*parts)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    members = {
        "publication-number": F.when(k % 53 != 0, q(text(n, F.lit("-2026")))),
        "procedure-identifier": F.when(k % 3 == 0, q(text(F.lit("proc-"), (k % 1000).cast("string")))),
        "notice-identifier": F.when(k % 3 == 1, q(text(F.lit("not-"), n))),
        "notice-type": _pick(k % 5, '"cn-standard"', '"can-standard"', '"pmc"', '"other-type"', "null"),
        "publication-date": q(text(day, F.lit("Z"))),
        "title-proc": F.when(k % 3 == 0, text(F.lit('{"eng":["T '), n, F.lit('"],"nld":"N  '), n, F.lit(' "}'))).when(
            k % 3 == 1, text(F.lit('{"fra":"F '), n, F.lit('","deu":"D '), n, F.lit('"}'))
        ),
        "title-lot": text(F.lit('{"mul":[" ","M '), n, F.lit('"]}')),
        "buyer-name": text(F.lit('{"nld":["'), F.concat(F.lit("Dienst "), F.col("o_custkey").cast("string")), F.lit('","Gemeente B","'), F.concat(F.lit("Dienst "), F.col("o_custkey").cast("string")), F.lit('"]}')),
        "procedure-type": _pick(k % 4, '"open"', '"restricted"', '"unheard-of"', "[1]"),
        "contract-nature": _pick(k % 3, '["works","services","works"]', '"supplies"', '"other"'),
        "classification-cpv": text(F.lit('["45000000","45000000","bad","7100000'), (k % 10).cast("string"), F.lit('"]')),
        "place-of-performance": F.lit('["NLD","NL32","NL32A","nl1","NL32"]'),
        "deadline-receipt-tender-date-lot": F.when(k % 5 == 1, text(F.lit('["'), day, F.lit('+02:00"]')))
        .when(k % 5 == 2, text(F.lit('["'), day, F.lit('+02:00"]')))
        .when(k % 5 == 3, text(F.lit('"'), day, F.lit('Z"')))
        .when(k % 5 == 4, text(F.lit('["soon","'), day, F.lit('","1990-01-01"]'))),
        "deadline-receipt-tender-time-lot": _pick(k % 5, "null", "null", '["10:00:00-05:00"]', '["22:59:00Z"]', '["12:00:00"]'),
        "estimated-value-proc": F.when(k % 4 == 0, text(F.lit('"'), n, F.lit('.5"'))).when(k % 4 == 1, F.lit('"-3"')),
        "estimated-value-cur-proc": F.lit('["EUR"]'),
        "estimated-value-lot": _pick(k % 4, "[1]", '["10.5",20]', "[10,null]", "[10,20]"),
        "estimated-value-cur-lot": _pick(k % 4, '["EUR"]', '["EUR","EUR"]', '["EUR"]', '["EUR","USD"]'),
        "links": F.when(k % 4 == 0, text(F.lit('{"html":{"ENG":"https://ted.europa.eu/en/'), n, F.lit('","NLD":"https://ted.europa.eu/nl/'), n, F.lit('"}}')))
        .when(k % 4 == 1, F.lit('{"html":{"ENG":"https://elsewhere.example.com/"}}'))
        .when(k % 4 == 2, text(F.lit('{"htmlDirect":{"FRA":"https://ted.europa.eu/fr/'), n, F.lit('"}}'))),
    }
    pairs = F.array(*(F.when(v.isNotNull(), F.concat(F.lit(f'"{name}":'), v)).otherwise(none) for name, v in members.items()))
    return o.select(k.alias("k"), F.concat(F.lit("{"), F.array_join(F.array_compact(pairs), ","), F.lit("}")).alias("json"))


def notice_map_multilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = N.map_notices(notice_json(spark, sf_dir))
    return facts.select(
        "k", "tender_identity", "publication_id", "title", "authority", "notice_type", "notice_label", "procedure", "contract",
        F.array_join(F.transform("cpv", lambda c: F.concat(c["code"], F.when(c["main"], F.lit("*")).otherwise(F.lit("")))), ",").alias("cpv"),
        F.array_join("nuts", ",").alias("nuts"), "published", "source_url",
    )


def deadline_local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.map_notices(notice_json(spark, sf_dir)).select("k", "deadline")


def lot_value_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.map_notices(notice_json(spark, sf_dir)).select("k", F.col("value.amount").alias("amount"), F.col("value.currency").alias("currency"))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fmt = lambda pattern, *args: F.format_string(pattern, *args)
    entry = F.when(k % 41 == 0, F.lit("not json")).otherwise(
        fmt(
            '{"publicatieId":%s,"kenmerk":%s,"aanbestedingNaam":%s,"typePublicatie":{"code":"AAO","omschrijving":"Aankondiging"},"procedure":%s,"publicatieDatum":%s,"sluitingsDatum":%s}',
            n, F.when(k % 3 == 0, fmt('"K%s"', (k % 500).cast("string"))).otherwise(F.lit("null")), F.when(k % 4 == 0, F.lit('"  "')).otherwise(fmt('"Naam  %s"', n)),
            F.when(k % 2 == 0, F.lit('{"omschrijving":"Openbaar"}')).otherwise(F.lit('"open"')), F.when(k % 5 == 0, F.lit("12")).otherwise(fmt('"%sT00:00:00"', day)),
            F.when(k % 7 == 0, F.lit("null")).otherwise(fmt('"%sT12:00:00"', day)),
        )
    )
    value = F.when(k % 3 == 0, n).when(k % 3 == 1, fmt('{"bedrag":%s.25,"valuta":"USD"}', n)).otherwise(F.lit('"veel"'))
    detail = fmt(
        '{"aanbestedingNaam":"Detail %s","opdrachtgeverNaam":"%s","procedureCode":{"omschrijving":"Anders"},"publicatieDatum":"2020-01-01","sluitingsDatum":"2020-02-02","cpvCodes":[{"code":"45000000-7","omschrijving":"Bouw","isHoofdOpdracht":true},{"code":"45000000"},{"code":"x"}],"nutsCodes":[{"code":"NL3","omschrijving":"West"},{"code":"NL3"},{"code":"NL4","omschrijving":"Zuid"}],"geschatteWaarde":%s,"pbNummerTed":"%s"}',
        n, F.concat(F.lit("Dienst "), F.col("o_custkey").cast("string")), value, F.when(k % 2 == 0, F.concat(n, F.lit("-2024"))).otherwise(F.lit("geen")),
    )
    entries = o.select(k.alias("k"), entry.alias("json"))
    # every sixth detail failed to load, every eleventh was never asked for
    details = o.where(k % 11 != 0).select(k.alias("k"), F.when(k % 6 != 0, detail).alias("json"))
    return entries, details


def notice_map_list_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = N.map_publications(*_entries(spark, sf_dir), "k")
    return facts.select(
        "k", "tender_identity", "publication_id", "title", "authority", "notice_label", "procedure", F.size("cpv").alias("codes"), F.array_join("nuts", ",").alias("nuts"),
        "location", "published", "deadline", F.col("value.amount").alias("amount"), F.col("value.currency").alias("currency"), "ted_number",
    )


def page_country_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages say of their country against a search for the Netherlands, by host ending and addresses in their data."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    host = F.concat(F.lit("www.site"), (n % 7).cast("string"), _pick(n % 5, ".nl", ".be", ".co.uk", ".com", ".io"))
    named = _pick(n % 4, "", " nl ", "NL,nl", "NL,Belgium,be")
    country = N.page_country(host, F.split(named, ","))
    return p.select(F.coalesce(country, F.lit("none")).alias("country"), N.location_status(country, "NL").alias("location")).groupBy("country", "location").agg(F.count(F.lit(1)).alias("pages"))


def tender_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of pages, and of their sections, which are numbered where a page has one name twice."""
    p = table(spark, sf_dir, "pages").where(F.col("url").isNotNull())
    url = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?utm_source=x&Ref="), (F.col("page_id") % 9).cast("string"), F.lit("&id=7#top"))
    ids = p.select("page_id", N.visit_key(url).alias("visit"), N.tender_page_identity(url).alias("identity"))
    sections = ids.select("page_id", "visit", "identity", F.posexplode(F.array(*(F.lit(x) for x in ("perceel", "perceel", "bijlage", "perceel")))).alias("ord", "name"))
    return N.numbered_repeats(sections, ["page_id"], "name", "ord", "section").select("page_id", "visit", F.concat("identity", F.lit("#"), "section").alias("item"))


QUERIES = {
    "notice_map_multilingual": notice_map_multilingual,
    "deadline_local_time": deadline_local_time,
    "lot_value_sum": lot_value_sum,
    "notice_map_list_detail": notice_map_list_detail,
    "page_country_gate": page_country_gate,
    "tender_page_keys": tender_page_keys,
}

_ORDERS = "n AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, 'Dienst ' || o_custkey AS o_clerk, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"

ORACLES = {
    "notice_map_multilingual": f"""WITH {_ORDERS}
      SELECT k, CASE k % 3 WHEN 0 THEN 'proc-' || k % 1000 WHEN 1 THEN 'not-' || s ELSE 'publicatie-' || s || '-2026' END AS tender_identity, s || '-2026' AS publication_id,
        CASE k % 3 WHEN 0 THEN 'N ' || s WHEN 1 THEN 'F ' || s ELSE 'M ' || s END AS title, o_clerk || '; Gemeente B' AS authority,
        CASE k % 5 WHEN 0 THEN 'cn-standard' WHEN 1 THEN 'can-standard' WHEN 2 THEN 'pmc' WHEN 3 THEN 'other-type' END AS notice_type,
        CASE k % 5 WHEN 0 THEN 'Aankondiging van een opdracht' WHEN 1 THEN 'Aankondiging van een gegunde opdracht' WHEN 2 THEN 'Marktconsultatie' WHEN 3 THEN 'other-type' END AS notice_label,
        CASE k % 4 WHEN 0 THEN 'Openbaar' WHEN 1 THEN 'Niet-openbaar' WHEN 2 THEN 'unheard-of' ELSE '[1]' END AS procedure,
        CASE k % 3 WHEN 0 THEN 'Werken / Diensten' WHEN 1 THEN 'Leveringen' ELSE 'other' END AS contract, '45000000*,7100000' || k % 10 AS cpv, 'NL32,NL32A' AS nuts, day AS published,
        CASE k % 4 WHEN 0 THEN 'https://ted.europa.eu/nl/' || s WHEN 2 THEN 'https://ted.europa.eu/fr/' || s ELSE 'https://ted.europa.eu/en/notice/-/detail/' || s || '-2026' END AS source_url
      FROM n WHERE k % 53 <> 0""",
    "deadline_local_time": f"""WITH {_ORDERS}
      SELECT k, CASE k % 5 WHEN 1 THEN day WHEN 2 THEN strftime(timezone('Europe/Amsterdam', CAST(day || ' 10:00:00-05' AS TIMESTAMPTZ)), '%Y-%m-%dT%H:%M:%S')
        WHEN 3 THEN strftime(timezone('Europe/Amsterdam', CAST(day || ' 22:59:00+00' AS TIMESTAMPTZ)), '%Y-%m-%dT%H:%M:%S') WHEN 4 THEN '1990-01-01T12:00:00' END AS deadline
      FROM n WHERE k % 53 <> 0""",
    "lot_value_sum": f"""WITH {_ORDERS}
      SELECT k, CASE k % 4 WHEN 0 THEN k + 0.5 WHEN 1 THEN 30.5 END::DOUBLE AS amount, CASE WHEN k % 4 < 2 THEN 'EUR' END AS currency FROM n WHERE k % 53 <> 0""",
    "notice_map_list_detail": f"""WITH {_ORDERS}, h AS (SELECT *, k % 11 <> 0 AND k % 6 <> 0 AS d FROM n WHERE k % 41 <> 0)
      SELECT k, CASE WHEN k % 3 = 0 THEN 'K' || k % 500 ELSE 'publicatie-' || s END AS tender_identity, s AS publication_id,
        CASE WHEN k % 4 <> 0 THEN 'Naam ' || s WHEN d THEN 'Detail ' || s END AS title, CASE WHEN d THEN o_clerk END AS authority, 'Aankondiging' AS notice_label,
        CASE WHEN k % 2 = 0 THEN 'Openbaar' WHEN d THEN 'Anders' END AS procedure, CAST(CASE WHEN d THEN 1 ELSE 0 END AS INTEGER) AS codes, CASE WHEN d THEN 'NL3,NL4' ELSE '' END AS nuts,
        CASE WHEN d THEN 'West, Zuid' END AS location, CASE WHEN k % 5 <> 0 THEN day WHEN d THEN '2020-01-01' END AS published,
        CASE WHEN k % 7 <> 0 THEN day || 'T12:00:00' WHEN d THEN '2020-02-02' END AS deadline,
        CASE WHEN d AND k % 3 = 0 THEN k WHEN d AND k % 3 = 1 THEN k + 0.25 END::DOUBLE AS amount, CASE WHEN d AND k % 3 = 0 THEN 'EUR' WHEN d AND k % 3 = 1 THEN 'USD' END AS currency,
        CASE WHEN d AND k % 2 = 0 THEN s || '-2024' END AS ted_number FROM h""",
    "page_country_gate": """WITH c AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'NL' WHEN 1 THEN 'BE' WHEN 2 THEN 'GB' END AS own,
        ([[], ['NL'], ['NL', 'NL'], ['NL', 'BE']])[CAST(p_partkey % 4 AS INTEGER) + 1] AS named FROM part),
      e AS (SELECT list_distinct(list_filter(list_append(named, own), lambda x: x IS NOT NULL)) AS all_ FROM c), f AS (SELECT CASE WHEN len(all_) = 1 THEN all_[1] END AS country FROM e)
      SELECT coalesce(country, 'none') AS country, CASE WHEN country IS NULL THEN 'unconfirmed' WHEN country = 'NL' THEN 'confirmed' ELSE 'foreign' END AS location, count(*) AS pages FROM f GROUP BY 1, 2""",
    "tender_page_keys": r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\.', '') AS host,
        regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE url IS NOT NULL AND url LIKE '%://%'),
      i AS (SELECT page_id, scheme, host || CASE WHEN path = '' THEN '/' ELSE path END || '?Ref=' || page_id % 9 || '&id=7' AS identity FROM u)
      SELECT page_id, scheme || '://' || identity AS visit, identity || '#' || s AS item FROM i, (SELECT unnest(['perceel', 'perceel-2', 'bijlage', 'perceel-3']) AS s)""",
}
