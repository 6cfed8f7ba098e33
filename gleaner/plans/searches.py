"""Searches as rows over the test tables: customers are requests, suppliers providers' sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import sentences
from gleaner.operators import searches as S
from gleaner.operators.notices import identity_key
from gleaner.operators.storage import new_path
from gleaner.streaming.changes import write_once

from .tables import table


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def query_plan_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search texts of tender requests, six each."""
    k = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey", _pick(k % 3, "bouw", "", "zorg").alias("branch"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("keywords"), F.when(k % 4 == 0, F.lit(" Utrecht ")).alias("region"), _pick(k % 5, "", "NL", "duitsland", "belgië", "mars").alias("country")
    )
    return S.tender_queries(requests, "c_custkey", 6)


def notice_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    codes = F.when(k % 3 == 0, F.array(F.lit("45"))).when(k % 3 == 1, F.array(F.lit("45"), F.lit("71"))).otherwise(none)
    q = S.notice_query(_pick(k % 2, "NLD", "BEL"), F.lit("2026-01-02"), F.lit("2026-02-01"), codes, F.when(k % 5 == 0, F.array(F.lit("NL32"))).otherwise(none), _pick(k % 4, "", "dak) OR x", "één woord", "b"))
    return table(spark, sf_dir, "customer").select("c_custkey", q.alias("query"))


def company_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    some = lambda n, *xs: F.when(k % n == 0, F.array(*(F.lit(x) for x in xs))).otherwise(none)
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey", some(2, "camera", "hek").alias("products"), some(5, "cctv").alias("specialisations"), some(3, "installatie").alias("services"), some(7, "ziekenhuizen").alias("sectors"), some(4, "Delft").alias("places"),
        F.when(k % 11 == 0, F.lit("zaak")).alias("query"), F.when(k % 13 == 0, F.lit("groothandel")).alias("role"), F.when(k % 6 == 0, F.lit("snel en goed")).alias("extra"), F.lit("bouwbedrijf").alias("noun"),
        F.lit("aannemer").alias("other_noun"), F.when(k % 9 == 0, F.lit("videobewaking")).alias("synonym"),
    )
    return S.company_queries(requests, "c_custkey", 8)


def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    many = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: i.cast("string"))
    none = F.array().cast("array<string>")
    why = S.request_problem({"query": F.when(k % 4 == 0, F.lit("x")), "country": _pick(k % 3, "NL", "Nederland", "Duitsland"), "products": F.when(k % 5 == 0, many).otherwise(none), "places": F.array(F.lit("Delft"))})
    return table(spark, sf_dir, "customer").select("c_custkey", why.alias("problem"))


def planned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = F.when(k % 3 == 0, F.array(F.lit("search"), F.lit("ted")))
    requests = table(spark, sf_dir, "customer").select("c_custkey", _pick(k % 2, "nl", "belgie").alias("country"), F.when(k % 5 != 0, F.lit("bouw")).alias("words"), (k % 7 != 0).alias("search_available"), asked.alias("sources"))
    return S.plan_sources(requests, "c_custkey").select("c_custkey", "source", "skipped")


def provider_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sites were asked for, and what came back of lines taken as their results."""
    l = table(spark, sf_dir, "lineitem").select(_pick(F.col("l_suppkey") % 4, "indeed", "linkedin", "web_search", "other").alias("site"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    names = spark.range(5).select(_pick(F.col("id"), "indeed", "linkedin", "web_search", "other", "silent").alias("site"), F.col("id"))
    sizes = names.select("site", S.request_size(F.lit(120), F.lit(150), F.lit(20), F.col("site")).alias("requested"), F.when(F.col("id") % 2 == 0, F.lit("timed out")).when(F.col("id") == 3, F.lit("blocked")).alias("error"))
    _, meta = S.provider_results(l, "site", "ord", sizes)
    chosen = S.choose_sources(F.array(F.lit("indeed"), F.lit("linkedin"), F.lit("web_search")), F.array(F.lit("linkedin"), F.lit("indeed")), F.when(F.length("site") > 6, F.array(F.col("site"), F.lit("indeed"))))
    return meta.select("site", "requested", "returned", "status", F.array_join(chosen["used"], ",").alias("used"), F.array_join(chosen["unknown"], ",").alias("unknown"))


GAZETTEER = [
    ("province", "Utrecht (provincie)", "Utrecht", "NL-UT"), ("province", "Zuid-Holland", "Zuid-Holland", "NL-ZH"), ("province", "Zuid-Holland", "ZH", "NL-ZH"),
    ("place", "Utrecht", "Utrecht", "NL-UT"), ("place", "Den Haag", "Den Haag", "NL-ZH"), ("place", "Den Haag", "'s-Gravenhage", "NL-ZH"),
]


def places_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(row, ("kind", "name", "alias", "province"), strict=True))) for row in GAZETTEER))))
    n = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", _pick(n % 7, "utrecht", "Provincie Utrecht", "zuid holland", "'S-GRAVENHAGE", "Utrecht (provincie)", "Atlantis", "provincie den haag").alias("said"))
    return S.find_places(p, "said", g).select("p_partkey", "kind", "name", "province")


def company_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration, addresses and the area served, from a footer and a sentence."""
    n = F.col("p_partkey")
    text = F.concat_ws(". ", _pick(n % 4, "KvK-nummer: 12345678", "kvk 1234567", "Chamber of Commerce no. 87654321", ""), _pick(n % 3, "Hoofdstraat 12, 2611 AB Delft, 2611AB Delft", "Postbus 5 1234 CD", "geen adres"), _pick(n % 5, "Werkgebied: heel Nederland", "Wij zijn landelijk bekend", "Actief in Delft", "heel nederland lacht", ""))
    a = S.addresses_in(text)
    return table(spark, sf_dir, "part").select(
        "p_partkey", S.registration_number(text).alias("kvk"), F.array_join(F.transform(a, lambda x: F.concat_ws("/", x["street"], x["postcode"], x["city"])), ";").alias("addresses"), S.serves_nation(sentences(text)).alias("national")
    )


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    c = S.company_identity(F.concat(F.lit("WWW"), n.cast("string"), F.lit(".NL")))
    return s.select("s_suppkey", c["identity"].alias("identity"), c["website"].alias("website"), identity_key(_pick(n % 3, "ted", "", "website"), F.when(n % 2 == 0, F.col("s_name"))).alias("tender_key"))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status from a stream whose last batch is written twice, as after a failure: nothing counts twice."""
    out, log = new_path(spark, "once"), new_path(spark, "once-log")
    orders = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parquet*")
    write = write_once(out)

    def twice(batch: DataFrame, number: int) -> None:
        write(batch, number)
        write(batch, number)

    orders.writeStream.foreachBatch(twice).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        query_plan_expansion, notice_queries, company_search_queries, request_problems, planned_sources, provider_requests, places_named, company_text_facts, identity_keys, stream_once,
    )
}

_NL = "['aanbesteding', 'tender', 'offerteaanvraag', 'request for proposal RFP', 'opdracht leverancier', 'inkoopkalender']"
_EN = "['tender', 'aanbesteding', 'request for proposal RFP', 'offerteaanvraag', 'request for quotation RFQ', 'procurement']"

ORACLES = {
    "query_plan_expansion": f"""WITH r AS (SELECT c_custkey AS k, (['bouw', NULL, 'zorg'])[CAST(c_custkey % 3 AS INTEGER) + 1] AS b, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS w, c_custkey % 5 AS c,
        CASE WHEN c_custkey % 4 = 0 THEN 'Utrecht' WHEN c_custkey % 5 = 2 THEN 'Duitsland' WHEN c_custkey % 5 = 3 THEN 'België' END AS reg FROM customer WHERE c_custkey % 5 <> 4),
      i AS (SELECT *, unnest(range(0, 6)) AS p FROM r)
      SELECT k AS c_custkey, CAST(p AS INTEGER) AS place, concat_ws(' ', (CASE WHEN c = 2 THEN {_EN} ELSE {_NL} END)[p + 1], b, w, reg) AS query FROM i""",
    "notice_queries": """SELECT c_custkey, concat_ws(' AND ', 'buyer-country=' || CASE WHEN c_custkey % 2 = 0 THEN 'NLD' ELSE 'BEL' END, 'publication-date>=20260102', 'publication-date<=20260201',
      CASE c_custkey % 3 WHEN 0 THEN 'classification-cpv=45*' WHEN 1 THEN '(classification-cpv=45* OR classification-cpv=71*)' END, CASE WHEN c_custkey % 5 = 0 THEN 'place-of-performance=NL32*' END,
      CASE c_custkey % 4 WHEN 1 THEN '(FT~"dak" OR FT~"OR" OR FT~"x")' WHEN 2 THEN '(FT~"één" OR FT~"woord")' WHEN 3 THEN '(FT~"b")' END) AS query FROM customer""",
    "company_search_queries": """WITH r AS (SELECT c_custkey AS k, k % 2 = 0 AS p, k % 5 = 0 AS sp, k % 3 = 0 AS se, k % 7 = 0 AS cu, CASE WHEN k % 4 = 0 THEN 'Delft' END AS wh, CASE WHEN k % 11 = 0 THEN 'zaak' END AS q, CASE WHEN k % 13 = 0 THEN 'groothandel' END AS ro,
        CASE WHEN k % 6 = 0 THEN 'snel en goed' END AS ex, CASE WHEN k % 9 = 0 THEN 'videobewaking' END AS sy FROM customer),
      t AS (SELECT *, CASE WHEN p THEN 'camera' WHEN sp THEN 'cctv' END AS what, CASE WHEN se THEN 'installatie' END AS sv, CASE WHEN cu THEN 'voor ziekenhuizen' END AS cust, CASE WHEN p THEN 'hek' END AS sec FROM r),
      a AS (SELECT k, wh, [concat_ws(' ', coalesce(ro, CASE WHEN what IS NOT NULL AND NOT se AND NOT cu THEN CASE WHEN p THEN 'leverancier' ELSE 'bouwbedrijf' END END), coalesce(what, CASE WHEN NOT se THEN 'bouwbedrijf' END), sv, cust, wh, ex),
        concat_ws(' ', coalesce(sy, CASE WHEN what IS NULL AND NOT se THEN 'aannemer' END), CASE WHEN what IS NOT NULL THEN sv END, cust, wh, CASE WHEN sy IS NOT NULL AND NOT se AND NOT cu THEN CASE WHEN p THEN 'bedrijf' ELSE 'bouwbedrijf' END END),
        concat_ws(' ', 'bouwbedrijf', CASE WHEN sp THEN 'cctv' ELSE sv END, cust, wh), CASE WHEN ro IS NOT NULL OR p THEN concat_ws(' ', coalesce(ro, 'leverancier'), coalesce(what, sv), cust, wh) END, concat_ws(' ', q, wh),
        CASE WHEN sec IS NOT NULL THEN concat_ws(' ', sec, wh) END] AS x FROM t),
      u AS (SELECT k, wh, x[i] AS q, i FROM a, (SELECT unnest(range(1, 7)) AS i)), f AS (SELECT k, min(q) AS query, min(i) AS i FROM u WHERE coalesce(q, '') <> '' AND q IS DISTINCT FROM wh GROUP BY k, lower(q))
      SELECT k AS c_custkey, CAST(row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS INTEGER) AS place, query FROM f""",
    "request_problems": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'too_many_values' WHEN c_custkey % 3 = 2 THEN 'country_not_searched' WHEN c_custkey % 4 <> 0 THEN 'no_subject' END AS problem FROM customer""",
    "planned_sources": """WITH r AS (SELECT c_custkey, unnest(['ted', 'tenderned', 'search']) AS source FROM customer)
      SELECT c_custkey, source, CASE WHEN source = 'tenderned' AND c_custkey % 2 = 1 THEN 'only_dutch_tenders' WHEN source = 'search' AND c_custkey % 5 = 0 THEN 'no_words' WHEN source = 'search' AND c_custkey % 7 = 0 THEN 'no_provider' END AS skipped
      FROM r WHERE c_custkey % 3 <> 0 OR source <> 'tenderned'""",
    "provider_requests": """WITH s AS (SELECT * FROM (VALUES ('indeed', 100, 0), ('linkedin', 30, 1), ('web_search', 150, 2), ('other', 30, 3), ('silent', 30, 4)) v(site, requested, id)),
      l AS (SELECT (['indeed', 'linkedin', 'web_search', 'other'])[CAST(l_suppkey % 4 AS INTEGER) + 1] AS site, count(*) AS n FROM lineitem GROUP BY 1)
      SELECT site, requested, least(coalesce(n, 0), requested) AS returned, CASE WHEN id = 1 THEN 'ok' WHEN n IS NULL THEN 'failed' ELSE 'partial' END AS status,
        CASE site WHEN 'linkedin' THEN 'indeed,linkedin' WHEN 'web_search' THEN 'indeed,web_search' ELSE 'indeed,linkedin' END AS used, '' AS unknown FROM s LEFT JOIN l USING (site)""",
    "places_named": """SELECT p_partkey, (['place', 'province', 'province', 'place', 'province', NULL, NULL])[CAST(p_partkey % 7 AS INTEGER) + 1] AS kind,
      (['Utrecht', 'Utrecht (provincie)', 'Zuid-Holland', 'Den Haag', 'Utrecht (provincie)', NULL, NULL])[CAST(p_partkey % 7 AS INTEGER) + 1] AS name,
      (['NL-UT', 'NL-UT', 'NL-ZH', 'NL-ZH', 'NL-UT', NULL, NULL])[CAST(p_partkey % 7 AS INTEGER) + 1] AS province FROM part""",
    "company_text_facts": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '12345678' WHEN 2 THEN '87654321' END AS kvk, CASE p_partkey % 3 WHEN 0 THEN 'Hoofdstraat 12/2611 AB/Delft' WHEN 1 THEN 'Postbus 5/1234 CD' ELSE '' END AS addresses,
      p_partkey % 5 IN (0, 1) AS national FROM part""",
    "identity_keys": """SELECT s_suppkey, 'www' || s_suppkey || '.nl' AS identity, 'https://www' || s_suppkey || '.nl/' AS website, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 1 THEN CASE s_suppkey % 3 WHEN 0 THEN 'ted|' ELSE 'website|' END || s_name END AS tender_key FROM supplier""",
    "stream_once": "SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1",
}
