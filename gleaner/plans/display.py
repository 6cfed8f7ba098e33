"""Small derivations of records over the test tables: what lists show, contacts, cursors, places, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import display as D
from gleaner.functions import employers
from gleaner.operators.scoring import Rule, present_and_missing, score

from .tables import FACTS_SQL, document_facts, table

PROVINCES = {"NL-ZH": "Zuid-Holland", "NL-UT": "Utrecht"}
ALIASES = {"nederland": "netherlands", "netherlands": "netherlands", "belgie": "belgium", "uk": "united kingdom", "united kingdom": "united kingdom"}


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def tender_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    code = lambda c, d, m: F.struct(F.lit(c).alias("code"), F.lit(d).cast("string").alias("description"), F.lit(m).alias("main"))
    codes = F.when(n % 3 == 0, F.array(code("1", "een", False), code("2", "twee", True))).when(n % 3 == 1, F.array(code("3", None, False))).otherwise(F.array().cast("array<struct<code:string,description:string,main:boolean>>"))
    made = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.local_date(F.when(n % 3 == 0, F.concat(day, F.lit("T08:30:00"))).when(n % 3 == 1, day).otherwise(F.lit("later"))).alias("shown"),
        D.tender_origin(_pick(n % 4, "ted", "tenderned", "website", "other"), F.when(n % 8 == 2, F.lit("web_search"))).alias("origin"),
        D.code_summary(codes).alias("codes"), D.location_summary(F.when(n % 2 == 0, F.lit("Delft")), F.when(n % 5 == 0, F.array(F.lit("NL3"), F.lit("NL4"))).otherwise(F.array().cast("array<string>"))).alias("location"),
        D.is_updated(made, made + F.make_dt_interval(secs=(n % 3).cast("decimal(8,6)"))).alias("updated"),
    )


def company_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", D.location_text(F.when(n % 2 == 0, F.col("s_name")), F.when(n % 3 == 0, F.lit("1234 AB")), F.when(n % 5 != 0, F.lit("Delft"))).alias("location"),
        D.area_text(_pick(n % 3, "national", "province", "place"), _pick(n % 2, "NL-ZH", "Gouda"), PROVINCES).alias("area"),
        D.short_list(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")), 1, (n % 6).cast("int"))).alias("short"),
    )


def criteria_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    none = F.array().cast("array<string>")
    lists = {"Branche": F.when(n % 2 == 0, F.array(F.lit("zorg"), F.col("c_mktsegment"))).otherwise(none), "Product": F.when(n % 3 == 0, F.array(F.lit("bedden"))).otherwise(none)}
    where = F.when(n % 5 == 0, F.array(F.lit("Delft"), F.lit("Utrecht"))).otherwise(none)
    line = D.criteria_summary(F.when(n % 4 == 0, F.col("c_name")), lists, where, F.when(n % 7 == 0, F.array(F.lit("horeca"))).otherwise(none))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))


def contact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.contact_rows(document_facts(spark, sf_dir), ["ord"], {"phone": "phone", "email": "email", "contact_person": "company"})


def tender_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    has = {"title": n % 2 == 0, "contractingAuthority": n % 3 == 0, "submissionDeadline": n % 5 == 0, "cpvCodes": n % 7 == 0, "referenceNumber": n % 11 == 0, "location": n % 13 == 0, "description": n % 4 == 0, "estimatedValue": n % 6 == 0}
    points = [15, 15, 20, 15, 10, 10, 10, 5]
    present, missing = present_and_missing(list(has.items()))
    rules = [Rule(k, c, p) for (k, c), p in zip(has.items(), points, strict=True)]
    return table(spark, sf_dir, "orders").select("o_orderkey", score(rules)["score"].alias("score"), F.array_join(present, ",").alias("present"), F.size(missing).alias("missing"))


def record_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they are stored, read back from their JSON."""
    f = document_facts(spark, sf_dir)
    sources = F.array(F.struct(F.lit("website").alias("type"), F.col("source_url").alias("url"), F.lit(None).cast("string").alias("label")))
    contacts = F.filter(F.array(F.struct(F.lit("email").alias("type"), F.col("email").alias("value"))), lambda c: c["value"].isNotNull())
    data = F.struct("title", "company", "location", "salary")
    e = f.select("ord", D.envelope(F.coalesce("title", "company"), data, F.array(F.lit("title")), F.array().cast("array<string>"), F.lit(20), sources, contacts).alias("e"))
    back = F.from_json("e.domain_data", "title string, company string, location string, salary string")
    return e.select("ord", F.col("e.display_name").alias("name"), back["location"].alias("location"), back["salary"].alias("salary"), F.size("e.contacts").alias("contacts"), F.get(F.col("e.sources"), F.lit(0))["url"].alias("url"))


def pairs_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by line status as a map, and back to rows in order of the key."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    as_map = l.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return as_map.select("l_suppkey", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("flags"))


def cursor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each site's hundred candidates as a cursor, and what a later run takes from it."""
    n = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        F.floor(n / 100).alias("site"), n.alias("ord"), F.concat(_pick(n % 4, "https://", "ftp://", "http://", "https://u:p@"), F.lit("d"), (n % 60).cast("string"), F.lit(".nl/x")).alias("url"), F.concat(F.lit("d"), (n % 60).cast("string"), F.lit(".nl")).alias("domain")
    )
    listed = c.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url", "domain"))), lambda x: F.struct(x["url"].alias("url"), x["domain"].alias("domain"))).alias("c"))  # a hundred at most
    read = D.read_cursor(D.cursor_json(F.col("c")), F.array(F.lit("d8.nl"), F.lit("d30.nl")))
    return listed.select("site", F.array_join(F.transform(read, lambda x: x["domain"]), ",").alias("domains"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(D.search_terms(F.substring_index("text", "\n", 1), F.col("source")), " ").alias("terms"))


def location_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    typed = _pick(n % 6, "ict, Den Haag", "zorg Den Haag nacht", "zuid-holland", "  verpleging ", "Zuid Holland; ict Delft", "haag")
    places = F.array(_pick(n % 2, "den haag", "Delft"), F.lit("Zuid-Holland"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", D.without_places(typed, places).alias("kept"))


def search_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    where = D.search_location(_pick(n % 4, "Nederland", "", "Atlantis", "uk"), _pick(n % 5, "Delft", "nederland", " ", "Netherlands", "UK"), ALIASES)
    p = table(spark, sf_dir, "part").select("p_partkey", where.alias("w"))
    return p.select("p_partkey", "w.*", D.board_location(F.lit("linkedin"), F.col("w")).alias("linkedin"), D.board_location(F.lit("indeed"), F.col("w")).alias("indeed"))


def countries_of_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    c = D.resolve_country(_pick(n % 5, "", " België ", "FRANCE", "Mars", "de"))
    return table(spark, sf_dir, "part").select("p_partkey", c["code"].alias("code"), c["alpha3"].alias("alpha3"), c["language"].alias("language"))


def category_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.format_string("%06d", "p_partkey").alias("code"), F.col("p_type").alias("label"), F.col("p_partkey").alias("ord"))
    return D.suggest_categories(c, "Steel", ["000007", "000003"], 12).select("code")


def job_board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a job board as candidates: salary as text, and whether a page has to be asked for more."""
    n = F.col("o_orderkey")
    low, high = F.when(n % 2 == 0, n), F.when(n % 3 == 0, n + 5)
    description, email = D.text_or_null(_pick(n % 3, "  ", "tekst ", "x"), 10_000), F.when(n % 4 == 0, F.lit("a@b.nl"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.salary_text(_pick(n % 2, "EUR", ""), low, high, F.lit("yearly")).alias("salary"), description.alias("description"), (description.isNull() & email.isNull()).alias("needs_enrichment")
    )


def poster_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    json = _pick(n % 5, '{"title":" Kok ","salary":12,"email":"a@b.nl"}', '["title"]', '{"title":"","company":{"a":1}}', "nonsense", '{"location":"Delft","title":"' + "x" * 301 + '"}')
    f = D.poster_facts(json)
    return table(spark, sf_dir, "part").select("p_partkey", *(f[c].alias(c) for c in ("title", "company", "location", "salary", "email")))


def contact_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    phone = _pick(n % 5, "tel:+31 (0)15-123 45 67", "015 1234567", "12", "TEL:0612345678", "call me")
    mail = _pick(n % 4, "mailto:Info@Zaak.NL?subject=x", "jan@zaak.nl", "no mail", " MAILTO:A@b.c")
    text = _pick(n % 3, "Mail jan@zaak.nl of Info@zaak.nl", "jan@zaak.nl", "orders.nl@zaak.nl")
    return table(spark, sf_dir, "part").select("p_partkey", D.phone_digits(phone).alias("phone"), D.email_address(mail).alias("email"), D.general_mail(text).alias("general"))


NAMES = ["Ministerie van Defensie", "de Bijenkorf", "wij zoeken jou", "Klik hier", "Acme B.V.", "Een zin. Nog een zin", "Is dit een naam?", "TNO", "functie in de zorg", " Van  der Valk "]


def employer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    name = _pick(n % len(NAMES), *NAMES)
    text = F.concat(F.lit("Inleiding\n - Werkgever: "), name, F.lit(" | Delft\nBedrijf - Later Genoemd\norganisatie: laatste"))
    chosen = employers.choose_company(F.when(n % 7 == 0, F.lit(" Ld  Naam ")), F.lit(None).cast("string"), F.when(n % 5 == 0, name), F.lit(""), employers.company_from_text(text), F.lit("Meta Naam"))
    return table(spark, sf_dir, "part").select("p_partkey", employers.company_name(name, "explicit").alias("explicit"), employers.company_from_text(text).alias("in_text"), chosen["value"].alias("chosen"), chosen["source"].alias("source"))


def organization_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    nodes = F.format_string(
        '[{"@type":"WebSite","name":"Site"},{"@type":"%s","name":"Zaak &amp;amp; %s","email":"mailto:INFO@z%s.nl","address":[{"addressLocality":" Den  Haag "},{"postalCode":"1"}]}]',
        _pick(n % 3, "Organization", "LocalBusiness", "Person"), n.cast("string"), n.cast("string"),
    )
    o = D.organization_of(nodes)
    return table(spark, sf_dir, "supplier").select("s_suppkey", o["name"].alias("name"), o["email"].alias("email"), F.array_join(o["cities"], ",").alias("cities"))


QUERIES = {
    f.__name__: f
    for f in (
        tender_display, company_display, criteria_summary, contact_rows, tender_completeness, record_envelopes, pairs_to_map, cursor_round_trip, search_terms, location_keywords, search_locations,
        countries_of_searches, category_suggestions, job_board_rows, poster_facts, contact_normalizers, employer_names, organization_data,
    )
}

_CASES = lambda key, n, *values: f"(CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END)"

ORACLES = {
    "tender_display": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%m-%Y') || ' 08:30' WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'later' END AS shown,
      CASE o_orderkey % 4 WHEN 0 THEN 'TED' WHEN 1 THEN 'TenderNed' WHEN 3 THEN 'other' ELSE CASE WHEN o_orderkey % 8 = 2 THEN 'Website (ontdekt via zoekopdracht)' ELSE 'Website van organisatie' END END AS origin,
      CASE o_orderkey % 3 WHEN 0 THEN '2 · twee (+1)' WHEN 1 THEN '3' END AS codes,
      nullif(concat_ws(' ', CASE WHEN o_orderkey % 2 = 0 THEN 'Delft' END, CASE WHEN o_orderkey % 5 = 0 THEN '(NL3, NL4)' END), '') AS location, o_orderkey % 3 = 2 AS updated FROM orders""",
    "company_display": """SELECT s_suppkey, nullif(concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN s_name END, nullif(concat_ws(' ', CASE WHEN s_suppkey % 3 = 0 THEN '1234 AB' END, CASE WHEN s_suppkey % 5 <> 0 THEN 'Delft' END), '')), '') AS location,
      CASE WHEN s_suppkey % 3 = 0 THEN 'Heel Nederland' WHEN s_suppkey % 2 = 1 THEN 'Gouda' WHEN s_suppkey % 3 = 1 THEN 'Zuid-Holland' ELSE 'NL-ZH' END AS area,
      CASE s_suppkey % 6 WHEN 1 THEN 'a' WHEN 2 THEN 'a, b' WHEN 3 THEN 'a, b, c' WHEN 4 THEN 'a, b, c (+1)' WHEN 5 THEN 'a, b, c (+2)' END AS short FROM supplier""",
    "criteria_summary": """SELECT c_custkey, concat_ws(' · ', CASE WHEN c_custkey % 4 = 0 THEN 'Zoekterm: ' || c_name END, CASE WHEN c_custkey % 2 = 0 THEN 'Branche: zorg, ' || c_mktsegment END,
      CASE WHEN c_custkey % 3 = 0 THEN 'Product: bedden' END, CASE WHEN c_custkey % 5 = 0 THEN 'Delft, Utrecht' ELSE 'Nederland' END, CASE WHEN c_custkey % 7 = 0 THEN 'Niet: horeca' END) AS line FROM customer""",
    "contact_rows": f"WITH {FACTS_SQL} SELECT ord, 'phone' AS type, phone AS value FROM facts WHERE phone IS NOT NULL UNION ALL SELECT ord, 'email', email FROM facts WHERE email IS NOT NULL UNION ALL SELECT ord, 'contact_person', company FROM facts WHERE company <> ''",
    "tender_completeness": """WITH h AS (SELECT o_orderkey AS k, [['title', '2', '15'], ['contractingAuthority', '3', '15'], ['submissionDeadline', '5', '20'], ['cpvCodes', '7', '15'], ['referenceNumber', '11', '10'], ['location', '13', '10'], ['description', '4', '10'], ['estimatedValue', '6', '5']] AS w FROM orders),
      f AS (SELECT k, list_filter(w, lambda x: k % CAST(x[2] AS INTEGER) = 0) AS yes FROM h)
      SELECT k AS o_orderkey, CAST(coalesce(list_sum(list_transform(yes, lambda x: CAST(x[3] AS INTEGER))), 0) AS INTEGER) AS score, array_to_string(list_transform(yes, lambda x: x[1]), ',') AS present, CAST(8 - len(yes) AS INTEGER) AS missing FROM f""",
    "record_envelopes": f"WITH {FACTS_SQL} SELECT ord, coalesce(title, company) AS name, location, salary, CAST(CASE WHEN email IS NULL THEN 0 ELSE 1 END AS INTEGER) AS contacts, source_url AS url FROM facts",
    "pairs_to_map": """SELECT l_suppkey, string_agg(l_returnflag || '=' || n, ',' ORDER BY l_returnflag) AS flags FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
    "cursor_round_trip": """WITH s AS (SELECT DISTINCT p_partkey // 100 AS site FROM part), c AS (SELECT p_partkey // 100 AS site, p_partkey % 60 AS d, min(p_partkey) AS o FROM part WHERE p_partkey % 4 IN (0, 2) AND p_partkey % 60 NOT IN (8, 30) GROUP BY 1, 2)
      SELECT site, coalesce(string_agg('d' || d || '.nl', ',' ORDER BY o), '') AS domains FROM s LEFT JOIN c USING (site) GROUP BY 1""",
    "search_terms": r"""WITH w AS (SELECT doc_id, regexp_split_to_array(translate(lower(split_part(text, chr(10), 1) || ' ' || source), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+') AS w FROM documents),
      u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM w), f AS (SELECT doc_id, w[i] AS t, min(i) AS o FROM u WHERE length(w[i]) >= 3 GROUP BY 1, 2)
      SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY o), '') AS terms FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY 1""",
    "location_keywords": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN "
    + _CASES("p_partkey", 6, "'ict'", "NULL", "NULL", "NULL", "'ict Delft'", "NULL")
    + " ELSE "
    + _CASES("p_partkey", 6, "NULL", "'zorg Den Haag nacht'", "NULL", "'verpleging'", "NULL", "'haag'")
    + " END AS kept FROM part",
    "countries_of_searches": f"SELECT p_partkey, {_CASES('p_partkey', 5, chr(39) + 'NL' + chr(39), chr(39) + 'BE' + chr(39), chr(39) + 'FR' + chr(39), 'NULL', chr(39) + 'DE' + chr(39))} AS code, "
    "CASE p_partkey % 5 WHEN 0 THEN 'NLD' WHEN 1 THEN 'BEL' WHEN 2 THEN 'FRA' WHEN 4 THEN 'DEU' END AS alpha3, CASE p_partkey % 5 WHEN 0 THEN 'nl' WHEN 1 THEN 'nl' WHEN 2 THEN 'en' WHEN 4 THEN 'en' END AS language FROM part",
    "search_locations": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS c, p_partkey % 5 AS r FROM part),
      w AS (SELECT p_partkey, CASE c WHEN 0 THEN 'netherlands' WHEN 3 THEN 'united kingdom' WHEN 1 THEN CASE WHEN r IN (1, 3) THEN 'netherlands' WHEN r = 4 THEN 'united kingdom' END END AS country,
        CASE c WHEN 0 THEN 'Netherlands' WHEN 3 THEN 'United Kingdom' WHEN 2 THEN 'Atlantis' WHEN 1 THEN CASE WHEN r IN (1, 3) THEN 'Netherlands' WHEN r = 4 THEN 'United Kingdom' END END AS label,
        CASE WHEN r = 2 OR (c = 0 AND r IN (1, 3)) OR (c = 3 AND r = 4) OR (c = 1 AND r IN (1, 3, 4)) THEN NULL ELSE (['Delft', 'nederland', '', 'Netherlands', 'UK'])[r + 1] END AS place FROM p)
      SELECT *, nullif(concat_ws(', ', place, label), '') AS linkedin, coalesce(place, label) AS indeed FROM w""",
    "category_suggestions": """SELECT printf('%06d', p_partkey) AS code FROM part WHERE lower(p_type) LIKE '%steel%' OR p_partkey IN (3, 7) ORDER BY CASE p_partkey WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END, p_partkey LIMIT 12""",
    "job_board_rows": """WITH j AS (SELECT o_orderkey AS n, CASE WHEN n % 2 = 0 AND n % 3 = 0 THEN n || '-' || n + 5 WHEN n % 2 = 0 THEN n || '' WHEN n % 3 = 0 THEN n + 5 || '' END AS a, CASE n % 3 WHEN 1 THEN 'tekst' WHEN 2 THEN 'x' END AS d FROM orders)
      SELECT n AS o_orderkey, CASE WHEN a IS NOT NULL THEN concat_ws(' ', CASE WHEN n % 2 = 0 THEN 'EUR' END, a, 'yearly') END AS salary, d AS description, d IS NULL AND n % 4 <> 0 AS needs_enrichment FROM j""",
    "poster_facts": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Kok' END AS title, CAST(NULL AS VARCHAR) AS company, CASE p_partkey % 5 WHEN 4 THEN 'Delft' END AS location, CAST(NULL AS VARCHAR) AS salary, CASE p_partkey % 5 WHEN 0 THEN 'a@b.nl' END AS email FROM part""",
    "contact_normalizers": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '+310151234567' WHEN 1 THEN '0151234567' WHEN 3 THEN '0612345678' END AS phone, CASE p_partkey % 4 WHEN 0 THEN 'info@zaak.nl' WHEN 1 THEN 'jan@zaak.nl' END AS email,
      CASE p_partkey % 3 WHEN 0 THEN 'info@zaak.nl' WHEN 2 THEN 'orders.nl@zaak.nl' END AS general FROM part""",
    "employer_names": """WITH n AS (SELECT p_partkey AS k, (['Ministerie van Defensie', 'de Bijenkorf', 'wij zoeken jou', NULL, 'Acme B.V.', 'Een zin. Nog een zin', NULL, 'TNO', 'functie in de zorg', 'Van der Valk'])[CAST(k % 10 AS INTEGER) + 1] AS e,
        (['Ministerie van Defensie', 'de Bijenkorf', NULL, NULL, 'Acme B.V.', NULL, NULL, 'TNO', NULL, 'Van der Valk'])[CAST(k % 10 AS INTEGER) + 1] AS t0 FROM part), u AS (SELECT *, coalesce(t0, 'Later Genoemd') AS t FROM n)
      SELECT k AS p_partkey, e AS explicit, t AS in_text, CASE WHEN k % 7 = 0 THEN 'Ld Naam' WHEN k % 5 = 0 AND e IS NOT NULL THEN e ELSE t END AS chosen,
        CASE WHEN k % 7 = 0 THEN 'json_ld' WHEN k % 5 = 0 AND e IS NOT NULL THEN 'explicit_label' ELSE 'text_fallback' END AS source FROM u""",
    "organization_data": """SELECT s_suppkey, CASE WHEN s_suppkey % 3 < 2 THEN 'Zaak &amp; ' || s_suppkey END AS name, CASE WHEN s_suppkey % 3 < 2 THEN 'info@z' || s_suppkey || '.nl' END AS email, CASE WHEN s_suppkey % 3 < 2 THEN 'Den Haag' END AS cities FROM supplier""",
}
