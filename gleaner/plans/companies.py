"""Company profiles, evaluation and vocabulary over the test tables: lines of orders are pages' hits, suppliers companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import url as U
from gleaner.operators import companies as C
from gleaner.operators.vocabulary import interpret

from .tables import table


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def company_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the hosts of search results."""
    n = F.col("p_partkey")
    host = _pick(n % 9, "www.kvk.nl", "nl.linkedin.com", "www.werkspot.nl", "maps.example.com", "www.minfin.gov.pl", "www.google.de", "bedrijf.nl", "nl.wikipedia.org", "en.nu.nl")
    kind = C.excluded_host_kind(host, U.registrable_domain(host))
    return table(spark, sf_dir, "part").select(F.coalesce(kind, F.lit("candidate")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("results"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    k, n = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_partkey")
    one = l.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    return one.select(
        F.col("l_suppkey").alias("company"), k.alias("ord"), _pick(n % 4, "product", "service", "customer_sector", "role").alias("kind"),
        F.when(n % 4 == 3, _pick(n % 3, "manufacturer", "installer", "importer")).otherwise(F.concat(F.lit("key"), (n % 6).cast("string"))).alias("key"),
        F.concat(F.lit("Label "), (n % 6).cast("string")).alias("label"), F.concat(F.lit("term"), (k % 7).cast("string")).alias("term"),
        (k % 5 == 0).alias("supply"), (k % 11 == 0).alias("structural"), (k % 2).alias("sentences"), F.col("l_quantity").cast("int").alias("count"),
        F.concat(F.lit("p"), k.cast("string")).alias("url"), (n % 8 == 1).alias("related"),
    )


_HITS_SQL = """one AS (SELECT l_suppkey AS company, l_orderkey * 10 + l_linenumber AS ord, min(l_partkey) AS n, CAST(min(l_quantity) AS INTEGER) AS cnt FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber),
  hits AS (SELECT company, ord, cnt, (['product', 'service', 'customer_sector', 'role'])[CAST(n % 4 AS INTEGER) + 1] AS kind,
    CASE WHEN n % 4 = 3 THEN (['manufacturer', 'installer', 'importer'])[CAST(n % 3 AS INTEGER) + 1] ELSE 'key' || n % 6 END AS key, 'Label ' || n % 6 AS label, 'term' || ord % 7 AS term,
    ord % 5 = 0 AS supply, ord % 11 = 0 AS structural, ord % 2 AS sentences, 'p' || ord AS url, n % 8 = 1 AS related FROM one),
  acts AS (SELECT company, kind, key, arg_min(label, ord) AS label, arg_min(related, ord) AS related,
    CASE WHEN NOT bool_or(related) AND (CASE WHEN kind = 'customer_sector' THEN bool_or(supply) ELSE bool_or(structural) OR sum(sentences) >= 2 END) THEN 'strong' ELSE 'weak' END AS strength,
    (list({'u': url, 't': term, 'o': ord} ORDER BY supply DESC, structural DESC, cnt DESC, ord)) AS ev, list(term ORDER BY ord) AS ts FROM hits GROUP BY 1, 2, 3)"""


def company_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.activities(_hits(spark, sf_dir), "company")
    return found.select("company", "kind", "key", "label", "strength", F.array_join("evidence", ",").alias("evidence"), F.size("terms").alias("terms"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 40).alias("company"), n.alias("ord"), F.concat(F.lit("u"), n.cast("string")).alias("url"), _pick(n % 5, "home", "about", "contact", "other", "other").alias("page_type"),
        F.when(n % 3 == 0, F.concat(F.lit("Merk "), (n % 4).cast("string"))).alias("site_name"), F.when(n % 17 == 0, F.concat(F.lit("Zaak "), n.cast("string"))).alias("legal_name"),
        F.when(n % 13 == 0, F.concat(F.lit("Org "), n.cast("string"))).alias("org_name"), F.when(n % 6 == 0, F.concat(F.lit("0"), n.cast("string"))).alias("phone"),
        F.when(n % 7 == 0, F.concat(F.lit("info@"), n.cast("string"))).alias("email"), F.when(n % 4 == 0, F.concat(F.lit("Over "), n.cast("string"))).alias("description"),
        F.when(n % 5 == 2, F.concat(F.lit("Stad "), (n % 30).cast("string"))).alias("city"), F.when(n % 9 == 0, F.concat(F.lit("Gebied "), (n % 50).cast("string"))).alias("area"),
        (n % 10 == 0).alias("cart"), (n % 3).alias("prices"), (n % 19 == 0).alias("product_data"), F.when(n % 29 == 0, F.array(F.lit("winkelwagen"))).otherwise(F.array().cast("array<string>")).alias("consumer_cues"),
        F.when(n % 8 == 0, F.array(_pick(n % 3, "offerte", "dealers", "zakelijk"))).otherwise(F.array().cast("array<string>")).alias("business_cues"),
        F.when(n % 23 == 0, F.lit(1)).otherwise(F.lit(0)).alias("addresses"), F.lit(None).cast("string").alias("registration"), F.lit(None).cast("string").alias("organization"),
    )


_PAGES_SQL = """pages_ AS (SELECT o_custkey % 40 AS company, o_orderkey AS ord, 'u' || o_orderkey AS url, (['home', 'about', 'contact', 'other', 'other'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS pt,
    CASE WHEN ord % 3 = 0 THEN 'Merk ' || ord % 4 END AS site, CASE WHEN ord % 17 = 0 THEN 'Zaak ' || ord END AS legal, CASE WHEN ord % 13 = 0 THEN 'Org ' || ord END AS org,
    CASE WHEN ord % 6 = 0 THEN '0' || ord END AS phone, CASE WHEN ord % 7 = 0 THEN 'info@' || ord END AS email, CASE WHEN ord % 4 = 0 THEN 'Over ' || ord END AS descr,
    CASE WHEN ord % 5 = 2 THEN 'Stad ' || ord % 30 END AS city, CASE WHEN ord % 9 = 0 THEN 'Gebied ' || ord % 50 END AS area FROM orders)"""


def company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.company_profile(_pages(spark, sf_dir), "company")
    return p.select("company", "name", F.array_join("trade_names", ",").alias("trade_names"), "description", "phone", "email", "contact_url", F.array_join("cities", ",").alias("cities"), F.array_join("areas", ",").alias("areas"))


def company_business_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.business_types(_pages(spark, sf_dir), C.activities(_hits(spark, sf_dir), "company"), "company")


def company_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a company is an authority or no company site, what of it is known, and what excludes it."""
    p = _pages(spark, sf_dir)
    k = F.col("company")
    profile = C.company_profile(p, "company").join(C.looks_like_company(p.where("page_type <> 'contact' and phone is null and email is null"), "company"), "company", "left")
    names = F.array(F.concat(_pick(k % 4, "Gemeente ", "gemeentehuis ", "Bakker ", "waterschap "), k.cast("string")))
    found = C.activities(_hits(spark, sf_dir), "company")
    exclusions = spark.range(2).select(F.col("id").alias("place"), F.when(F.col("id") == 0, F.lit("key4")).otherwise(F.lit("key1")).alias("key"))
    flagged = C.excluded_by(profile, found, exclusions, "company")
    known = {
        "name": F.col("name").isNotNull(), "description": F.col("description").isNotNull(), "location": F.size("cities") > 0, "serviceArea": F.size("areas") > 0,
        "contact": F.col("phone").isNotNull() | F.col("email").isNotNull() | F.col("contact_url").isNotNull(),
    }
    known |= {s: F.lit(False) for s in C.PROFILE_SIGNALS if s not in known}
    present, missing = C.profile_signals(known)
    domain = _pick(k % 3, "a.nl", "provincie-utrecht.nl", "b.overheid.nl")
    return flagged.select("company", C.is_public_authority(names, domain).alias("authority"), F.coalesce("company_site", F.lit(False)).alias("company_site"), F.array_join(present, ",").alias("present"), F.size(missing).alias("missing"), "excluded_by")


def _facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array(F.concat(F.lit("branche "), (F.col("c_custkey") % 5).cast("string")), F.col("c_mktsegment")).alias("industry"),
        F.array(F.col("c_nationkey").cast("string")).alias("region"), _pick(F.col("c_custkey") % 3, "confirmed", "possible", "insufficient").alias("status"),
    )


def company_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.filter_companies(_facets(spark, sf_dir), {"industry": "BUILDING", "region": None, "status": "confirmed", "customer": ""})
    return kept.select("c_custkey")


def company_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.facet_options(_facets(spark, sf_dir), "industry")


CONCEPTS = [("cctv", "product", 0, "camerabeveiliging"), ("cctv", "product", 0, "beveiligingscamera"), ("zorg", "customer_sector", 1, "zorg"), ("school", "customer_sector", 2, "onderwijs"), ("school", "customer_sector", 2, "school")]


def _concepts(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, ("concept", "kind", "place", "term"), strict=True))) for c in CONCEPTS))))


def concept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    values = table(spark, sf_dir, "part").select(
        n.alias("ord"), _pick(n % 2, "product", "customer_sector").alias("kind"), _pick(n % 6, " Beveiligingscamera ", "School", "hekwerk", "zorg!", "camerabeveiliging", "kerk").alias("value")
    )
    return C.expand_terms(values, _concepts(spark)).select("ord", "concept", F.array_join("terms", ",").alias("terms"))


def concept_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in texts, longest first: a compound takes its words before a shorter term may."""
    n = F.col("p_partkey")
    text = F.concat_ws(" ", _pick(n % 3, "Wij leveren zorg software aan scholen.", "Zorg en school, zorg!", "Niets van dit alles"), _pick(n % 4, "", "Zorg software", "beveiligingscamera's", "schoolgebouwen"))
    found = C.scan_terms(table(spark, sf_dir, "part").select(n.alias("ord"), text.alias("text")), ["zorg", "zorg software", "school", "beveiligingscamera"])
    return found.select("ord", F.array_join("found", ",").alias("found"))


def criterion_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How suppliers meet an activity and a place."""
    n = F.col("s_suppkey")
    activity = C.activity_match(n % 3 == 0, n % 3 == 1, n % 2 == 0, n % 7 == 0)
    place = C.place_match(n % 5 == 0, F.when(n % 4 == 0, n % 8 == 0), n % 6 == 1, n % 6 == 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", activity.alias("activity"), place.alias("place"))


TERMS = [("zorg", "zorginstelling", "customer_sector"), ("zorg software", "zorgsoftware", "product"), ("school", "onderwijs", "customer_sector"), ("beveiligingscamera", "cctv", "product"), ("Utrecht", "NL-UT", "place")]


def interpreted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in plain words: terms with endings and tails, the longer before the shorter, exclusions and what is left."""
    terms = spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, ("term", "concept", "kind"), strict=True))) for t in TERMS))))
    n = F.col("p_partkey")
    text = F.concat(_pick(n % 4, "Leveranciers van zorg software voor scholen", "Zorg en schools, zorg!", "beveiligingscamerasysteem voor zorgs", "iets anders"), _pick(n % 3, "", ", geen kleine aannemers, Utrecht", " zonder school. 2026"))
    requests = table(spark, sf_dir, "part").select("p_partkey", text.alias("said"))
    found = interpret(requests, "p_partkey", "said", terms)
    told = F.transform("criteria", lambda c: F.concat_ws(":", c["kind"], c["concept"]))
    return found.select("p_partkey", F.array_join(told, ",").alias("criteria"), F.array_join("exclusions", ",").alias("exclusions"), F.array_join("unrecognized", ",").alias("unrecognized"))


QUERIES = {
    f.__name__: f
    for f in (
        interpreted_requests,
        company_hosts, company_activities, company_profile, company_business_types, company_flags, company_filter, company_facets, concept_expansion, concept_scan, criterion_matches,
    )
}

ORACLES = {
    "company_hosts": """SELECT (['directory', 'social', 'review_or_comparison', 'search_or_maps', 'government', 'search_or_maps', 'candidate', 'reference', 'media'])[CAST(p_partkey % 9 AS INTEGER) + 1] AS kind, count(*) AS results FROM part GROUP BY 1""",
    "company_activities": f"""WITH {_HITS_SQL} SELECT company, kind, key, label, strength, array_to_string(list_transform(ev[1:3], lambda x: x.u), ',') AS evidence,
      CAST(least(5, len(list_distinct(ts))) AS INTEGER) AS terms FROM acts""",
    "company_profile": f"""WITH {_PAGES_SQL},
      c AS (SELECT DISTINCT company, first_value(city) OVER w AS city, min(ord) OVER (PARTITION BY company, city) AS o FROM pages_ WHERE city IS NOT NULL WINDOW w AS (PARTITION BY company, city ORDER BY ord)),
      cc AS (SELECT company, array_to_string((list(city ORDER BY o))[1:10], ',') AS cities FROM c GROUP BY 1),
      a AS (SELECT company, area, min(ord) AS o FROM pages_ WHERE area IS NOT NULL GROUP BY 1, 2), aa AS (SELECT company, array_to_string((list(area ORDER BY o))[1:15], ',') AS areas FROM a GROUP BY 1)
      SELECT company, coalesce(arg_min(legal, ord) FILTER (legal IS NOT NULL), arg_min(org, ord) FILTER (org IS NOT NULL), arg_min(site, ord) FILTER (site IS NOT NULL)) AS name,
        coalesce(array_to_string(list_sort(list_distinct(list(site) FILTER (site IS NOT NULL))), ','), '') AS trade_names,
        coalesce(arg_min(descr, ord) FILTER (pt = 'home' AND descr IS NOT NULL), arg_min(descr, ord) FILTER (pt = 'about' AND descr IS NOT NULL)) AS description,
        coalesce(arg_min(phone, ord) FILTER (pt = 'contact' AND phone IS NOT NULL), arg_min(phone, ord) FILTER (phone IS NOT NULL)) AS phone,
        coalesce(arg_min(email, ord) FILTER (pt = 'contact' AND email IS NOT NULL), arg_min(email, ord) FILTER (email IS NOT NULL)) AS email,
        arg_min(url, ord) FILTER (pt = 'contact') AS contact_url, coalesce(any_value(cities), '') AS cities, coalesce(any_value(areas), '') AS areas
      FROM pages_ LEFT JOIN cc USING (company) LEFT JOIN aa USING (company) GROUP BY 1""",
    "company_business_types": f"""WITH {_HITS_SQL}, {_PAGES_SQL},
      s AS (SELECT company, bool_or(ord % 10 = 0) AS cart, sum(ord % 3) AS prices, bool_or(ord % 19 = 0) AS data, bool_or(ord % 29 = 0) AS consumer, count(DISTINCT CASE WHEN ord % 8 = 0 THEN ord % 3 END) AS b FROM pages_ GROUP BY 1),
      t AS (SELECT company, 'consumer_webshop' AS type, CASE WHEN cart AND (prices >= 3 OR data) THEN 'strong' ELSE 'weak' END AS strength FROM s WHERE (cart AND (prices >= 3 OR data)) OR (prices >= 5 AND consumer)
        UNION ALL SELECT company, 'b2b_supplier', CASE WHEN b >= 2 THEN 'strong' ELSE 'weak' END FROM s WHERE b > 0
        UNION ALL SELECT company, CASE key WHEN 'manufacturer' THEN 'manufacturer' ELSE 'service_provider' END, strength FROM acts WHERE kind = 'role' AND key <> 'importer'
        UNION ALL SELECT company, 'service_provider', 'strong' FROM acts WHERE kind = 'service' AND strength = 'strong' AND NOT related)
      SELECT company, type, min(strength) AS strength FROM t GROUP BY 1, 2""",
    "company_flags": f"""WITH {_HITS_SQL}, {_PAGES_SQL},
      l AS (SELECT company, bool_or(ord % 23 = 0) AS site FROM pages_ WHERE pt <> 'contact' AND phone IS NULL AND email IS NULL GROUP BY 1),
      x AS (SELECT company, CASE WHEN bool_or(key = 'key4') THEN 'key4' ELSE 'key1' END AS ex FROM acts WHERE strength = 'strong' AND NOT related AND key IN ('key4', 'key1') GROUP BY 1),
      p AS (SELECT company, bool_or(legal IS NOT NULL OR org IS NOT NULL OR site IS NOT NULL) AS n, bool_or(descr IS NOT NULL AND pt IN ('home', 'about')) AS d, bool_or(city IS NOT NULL) AS c, bool_or(area IS NOT NULL) AS a,
        bool_or(phone IS NOT NULL OR email IS NOT NULL OR pt = 'contact') AS k FROM pages_ GROUP BY 1)
      SELECT p.company, p.company % 4 IN (0, 3) OR p.company % 3 > 0 AS authority, coalesce(l.site, false) AS company_site,
        concat_ws(',', CASE WHEN n THEN 'name' END, CASE WHEN d THEN 'description' END, CASE WHEN c THEN 'location' END, CASE WHEN a THEN 'serviceArea' END, CASE WHEN k THEN 'contact' END) AS present,
        CAST(9 - n::INT - d::INT - c::INT - a::INT - k::INT AS INTEGER) AS missing, ex AS excluded_by FROM p LEFT JOIN l USING (company) LEFT JOIN x USING (company)""",
    "company_filter": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 = 0",
    "company_facets": """WITH v AS (SELECT DISTINCT unnest(['branche ' || c_custkey % 5, c_mktsegment]) AS value FROM customer)
      SELECT value, CAST(row_number() OVER (ORDER BY lower(value)) AS INTEGER) AS place FROM v""",
    "concept_expansion": """SELECT p_partkey AS ord, CASE WHEN p_partkey % 6 IN (0, 4) THEN 'cctv' WHEN p_partkey % 6 = 1 THEN 'school' WHEN p_partkey % 6 = 3 THEN 'zorg' END AS concept,
      (['beveiligingscamera,camerabeveiliging', 'onderwijs,school', 'hekwerk', 'zorg', 'beveiligingscamera,camerabeveiliging', 'kerk'])[CAST(p_partkey % 6 AS INTEGER) + 1] AS terms FROM part""",
    "concept_scan": """SELECT p_partkey AS ord, concat_ws(',', CASE WHEN p_partkey % 4 = 2 THEN 'beveiligingscamera' END, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 1 THEN 'zorg software' END,
      CASE WHEN p_partkey % 3 = 1 THEN 'school,zorg' END) AS found FROM part""",
    "interpreted_requests": """WITH b AS (SELECT p_partkey, (['product:zorgsoftware', 'customer_sector:zorginstelling,customer_sector:onderwijs', 'product:cctv', ''])[CAST(p_partkey % 4 AS INTEGER) + 1] AS c,
        (['leveranciers,scholen', '', 'zorgs', 'iets,anders'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS u FROM part)
      SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN concat_ws(',', nullif(c, ''), 'place:NL-UT') ELSE c END AS criteria,
        (['', 'kleine aannemers', 'school'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS exclusions, u AS unrecognized FROM b""",
    "criterion_matches": """WITH s AS (SELECT s_suppkey, s_suppkey AS n FROM supplier)
      SELECT s_suppkey, CASE n % 3 WHEN 0 THEN CASE WHEN n % 2 = 0 THEN 'confirmed' ELSE 'possible' END WHEN 1 THEN 'possible' ELSE CASE WHEN n % 7 = 0 THEN 'possible' ELSE 'insufficient' END END AS activity,
        CASE WHEN n % 5 = 0 OR n % 8 = 0 THEN 'confirmed' WHEN n % 6 IN (1, 2) THEN 'possible' ELSE 'insufficient' END AS place FROM s""",
}
