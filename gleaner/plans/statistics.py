"""Run statistics, vacancy identity and the vacancy run as one plan, over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import url as U
from gleaner.functions.dates import within_days
from gleaner.functions.text import dedupe_key
from gleaner.operators import dedupe, funnel
from gleaner.operators import statistics as S
from gleaner.operators.scoring import score
from gleaner.operators.storage import materialize

from .records import _POINTS_SQL, NOW, completeness_rules
from .tables import FACTS_SQL, document_facts, table


def _pick(i: Column, *values: object) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), i.cast("int"))


def crawl_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests, hosts as crawls; a page without query is one thing however it is asked for."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    requests = p.select(
        U.host(F.col("url")).alias("site"), "url", F.when(n % 3 != 0, F.regexp_replace("url", r"[?#].*$", "")).alias("identity"),
        _pick(n % 5, "ok", "redirect", "failed", "http_error", "skipped").alias("status"), (n % 7 != 0).alias("attempted"), (n % 100).alias("score"),
        (n % 4 == 0).alias("known"), (n % 8 == 0).alias("unchanged"),
    )
    return S.crawl_statistics(requests, "site")


def crawler_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    health = S.crawler_health(F.when(n % 5 == 0, F.lit("launch")), _pick(n % 3, "ok", "failed", "partial"), n % 4)
    return e.select(F.coalesce(health, F.lit("as it is")).alias("health")).groupBy("health").agg(F.count(F.lit(1)).alias("crawls"))


def tally_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = table(spark, sf_dir, "part"), F.col("p_partkey")
    codes = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("4"), (n % 10).cast("string"), F.lit("000000"))))
    a = p.select(
        F.concat(F.lit("site"), (n % 6).cast("string")).alias("site"), _pick(n % 5, "detail", "overview", "general", "detail", "detail").alias("kind"),
        F.when(n % 10 == 1, F.lit("no_deadline")).alias("rejection"), _pick(n % 3, "confirmed", "foreign", "unconfirmed").alias("location"), codes.alias("codes"),
    )
    outcome = S.assessment_outcome(F.col("kind"), F.col("rejection"), F.col("location"), F.col("codes"), ["45", "41"])
    t = S.tally(a.withColumn("outcome", outcome), "site", ["45", "41"])
    return t.withColumn("reasons", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


def tender_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    t = o.select(
        (n % 7).alias("run"), _pick(n % 3, "ted", "tenderned", "website").alias("system"), _pick(n % 4, "open", "expired", "unknown", "open").alias("status"),
        _pick(n % 2, "confirmed", "unconfirmed").alias("location"), F.array(F.concat((n % 90 + 10).cast("string"), F.lit("000000"))).alias("codes"),
    )
    groups = o.groupBy((n % 7).alias("run"), (n % 3).alias("source")).agg(
        F.lit(True).alias("exhausted"), F.when(F.max(n % 7) == 3, F.lit("time_limit")).otherwise(F.lit("exhausted")).alias("stop_reason"),
        F.when(F.max(n % 21) == 8, F.lit(2)).otherwise(F.lit(0)).alias("detail_failures"), F.lit("complete").alias("status"),
    )
    return S.tender_run_statistics(t, "run", ["45", "7"]).join(S.coverage_complete(groups, "run"), "run")


def company_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    companies = c.where("c_nationkey % 5 <> 4").select(F.col("c_nationkey").alias("run"), _pick(n % 4, "confirmed", "possible", "insufficient", "possible").alias("status"))
    k = F.col("n_nationkey")
    sources = table(spark, sf_dir, "nation").select(
        k.alias("run"), (k % 3).alias("sites_failed"), (k % 2).alias("sites_incomplete"), F.when(k % 6 == 0, F.lit(4)).alias("not_researched"), (k % 7 == 0).alias("time_limit"), F.lit(0).alias("query_errors")
    )
    return S.company_run_statistics(companies, sources, "run").withColumn("incomplete_reasons", F.array_join("incomplete_reasons", "; "))


def continuation_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    runs = e.select("event_id", F.when(n % 3 != 0, F.col("user_id")).alias("continues"), F.col("ts").alias("created"), F.when(n % 4 == 1, F.lit("failed")).otherwise(F.lit("running")).alias("status"))
    return S.claim_continuations(runs, "continues", ["created", "event_id"]).select("event_id", "continues", "claims")


def enrichment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five records of a source without description and e-mail are filled from a page, whose own fields never win."""
    f = document_facts(spark, sf_dir)
    granted = S.within_budget(f, "company", "ord", F.col("ord") % 3 == 0, 5)
    page = f.select((F.col("ord") - 1).alias("page_of"), F.col("language").alias("page_location"), F.lit("page").alias("page_salary"))
    joined = granted.join(page, F.col("granted") & (F.col("ord") == F.col("page_of")), "left")
    return joined.select("ord", "granted", F.coalesce("location", "page_location").alias("location"), F.coalesce("salary", "page_salary").alias("salary"))


def company_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of search results in order, without those of domains researched before."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), U.registrable_domain(U.host(F.col("url"))).alias("domain"), "url", F.col("page_id").cast("string").alias("title"), (F.col("page_id") % 4).alias("hits"))
    p = p.withColumn("domain", F.concat((F.col("ord") % 13).cast("string"), F.lit("."), "domain"))
    found = S.candidates_by_domain(p, "domain", "ord")
    done = found.where(F.length("domain") % 3 == 0)
    left = S.without_known(found, done, "domain")
    return left.withColumn("place", F.row_number().over(Window.orderBy("sort"))).select("domain", "results", "hits", "title", "place").where("place <= 25")


def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best results: points of the link and six for each term found, the earlier of equals first."""
    p, n = table(spark, sf_dir, "pages"), F.col("page_id")
    points = n % 40 + 6 * (n % 5)
    return p.select("page_id", points.alias("score")).orderBy(F.col("score").desc(), "page_id").limit(50)


def publications_to_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order that its stored form does not have, as a difference of arrays and as rows without a partner."""
    l = table(spark, sf_dir, "lineitem")
    incoming = l.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("now"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))).alias("before"))
    by_array = incoming.select("l_orderkey", F.size(F.array_except("now", "before")).alias("new_publications"))
    stored = l.where("l_linenumber % 2 = 0").select("l_orderkey", "l_partkey").distinct()
    by_rows = l.select("l_orderkey", "l_partkey").distinct().join(stored, ["l_orderkey", "l_partkey"], "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"))
    return by_array.join(by_rows, "l_orderkey", "left").select("l_orderkey", "new_publications", F.coalesce("rows", F.lit(0)).cast("int").alias("rows"))


KEYS = [("k_url", 100), ("k_identity", 100), ("k_ctl", 95), ("k_ct", 50)]


def with_identity_keys(facts: DataFrame) -> DataFrame:
    """The four keys of a vacancy: its page, its identifier on the site, company with title and place, company with title."""
    title, company, place = dedupe_key(F.col("title")), dedupe_key(F.col("company")), dedupe_key(F.col("location"))
    return facts.withColumns(
        {"k_url": F.col("source_url"), "k_identity": U.job_identity(F.col("source_url")), "k_ctl": F.concat_ws("|", F.when(title.isNotNull() & place.isNotNull(), company), title, place), "k_ct": F.concat(company, F.lit("|"), title)}
    ).withColumn("k_ctl", F.when(title.isNotNull() & place.isNotNull() & company.isNotNull(), F.col("k_ctl")))


def _vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose URLs carry an identifier on every second one, under two addresses."""
    f = document_facts(spark, sf_dir)
    n = F.col("ord")
    by_path = F.concat(F.lit("https://www."), "company", F.lit(".example.com/jobs/jobid:"), F.floor(n / 40).cast("string"), F.lit("00"))
    by_query = F.concat(F.lit("https://"), "company", F.lit(".example.com/nl/vacature?x="), n.cast("string"), F.lit("&jobid="), F.floor(n / 40).cast("string"), F.lit("00"))
    return f.withColumn("source_url", F.when(n % 4 == 0, by_path).when(n % 4 == 2, by_query).otherwise(F.col("source_url")))


_VACANCY_KEYS_SQL = (
    FACTS_SQL
    + r""", vac AS (SELECT * REPLACE (CASE ord % 4 WHEN 0 THEN 'https://www.' || company || '.example.com/jobs/jobid:' || CAST(ord // 40 AS VARCHAR) || '00'
      WHEN 2 THEN 'https://' || company || '.example.com/nl/vacature?x=' || ord || '&jobid=' || CAST(ord // 40 AS VARCHAR) || '00' ELSE source_url END AS source_url) FROM facts),
    parts AS (SELECT *, lower(trim(regexp_replace(company, '\s+', ' ', 'g'))) AS c, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS t, lower(trim(location)) AS p FROM vac),
    vkeys AS (SELECT *, source_url AS k_url, CASE WHEN ord % 2 = 0 THEN company || '|' || CAST(ord // 40 AS VARCHAR) END AS k_identity, c || '|' || t || '|' || p AS k_ctl, c || '|' || t AS k_ct FROM parts)
"""
)


def vacancy_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by four signals, best first: of equal scores the one whose first signal, then ordinals, come first."""
    keyed = with_identity_keys(_vacancies(spark, sf_dir))
    names = {"k_url": "sourceUrl", "k_identity": "stableJobIdentity", "k_ctl": "companyTitleLocation", "k_ct": "companyTitle"}
    pairs = dedupe.duplicate_pairs(keyed, [dedupe.ExactSignal(names[k], p, F.col(k)) for k, p in KEYS], 90, 40, names=("duplicate", "possible_duplicate"))
    return pairs.select("a", "b", "score", F.array_join("signals", ",").alias("signals"), "decision")


def match_existing_by_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English records are stored, the others come in."""
    keyed = with_identity_keys(_vacancies(spark, sf_dir))
    found = S.match_any_key(keyed.where("language <> 'en'"), keyed.where("language = 'en'"), KEYS, 40, 90)
    return found.where("possible").select(F.col("ord").alias("doc_id"), "score", F.col("match").alias("stored"))


def vacancy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a run with their outcome and whether they are stored, the best record of each group first found."""
    facts = with_identity_keys(_vacancies(spark, sf_dir)).withColumn("points", score(completeness_rules())["score"])
    stored, fresh = facts.where("language = 'en'"), facts.where("language <> 'en'")
    in_time = within_days(F.col("posted"), F.lit(NOW).cast("timestamp"), 40)
    timely = fresh.where(in_time)
    links = dedupe.collapse_by_key(timely, [F.col("k_url"), F.col("k_identity"), F.col("k_ctl")])
    survivors = dedupe.collapse(timely, links, F.col("points")).select(F.col("ord").alias("member"), "survivor")
    known = S.match_any_key(timely, stored, KEYS, 40, 90).select(F.col("ord").alias("matched"), "match", "possible")
    joined = fresh.withColumn("in_time", in_time).join(survivors, F.col("ord") == F.col("member"), "left").join(known, F.col("ord") == F.col("matched"), "left")
    outcome = (
        F.when(~F.col("in_time"), F.lit("date_rejected"))
        .when(F.col("survivor") != F.col("ord"), F.lit("duplicate_in_run"))
        .when(F.col("match").isNotNull() | F.col("possible"), F.lit("already_known"))
        .otherwise(F.lit("new"))
    )
    return joined.select("ord", "company", "points", "match", outcome.alias("outcome"))


def vacancy_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vacancy run in one plan: dates, duplicates in the run, stored records by four keys, then the breakdown by source.

    New records beyond 20 of a source, the best first, are cut by its target.
    """
    # both the facts and the sites read it
    done = materialize(vacancy_outcomes(spark, sf_dir).select("ord", "company", "points", "outcome"), "outcomes")
    place = F.row_number().over(Window.partitionBy("company", "outcome").orderBy(F.col("points").desc(), "ord"))
    facts = done.select(F.col("company").alias("site"), (F.col("ord") % 9 != 0).alias("relevant"), "outcome", (place <= 20).alias("stored"))
    n = F.count(F.lit(1))
    sites = done.groupBy(F.col("company").alias("site")).agg((n + 3).alias("discovered"), (n + 1).alias("attempted"), n.alias("with_data"))
    return funnel.run_breakdown(sites, facts)


QUERIES = {
    f.__name__: f
    for f in (
        crawl_statistics, crawler_health, tally_assessments, tender_run_statistics, company_run_statistics, continuation_claim, enrichment_budget, company_candidates,
        search_candidates, publications_to_add, vacancy_duplicates, match_existing_by_any_key, vacancy_outcomes, vacancy_run,
    )
}

_MATCH_SQL = """hits AS (
      SELECT i.ord a, s.ord b, 100 points FROM inc i JOIN sto s ON i.k_url = s.k_url UNION ALL SELECT i.ord, s.ord, 100 FROM inc i JOIN sto s ON i.k_identity = s.k_identity
      UNION ALL SELECT i.ord, s.ord, 95 FROM inc i JOIN sto s ON i.k_ctl = s.k_ctl UNION ALL SELECT i.ord, s.ord, 50 FROM inc i JOIN sto s ON i.k_ct = s.k_ct),
    scored AS (SELECT a, b, least(100, sum(points)) AS score FROM hits GROUP BY 1, 2),
    best AS (SELECT a, CAST(max(score) AS INTEGER) AS score, min(b) FILTER (score >= 90) AS stored FROM scored WHERE score >= 40 GROUP BY 1)"""

_OUTCOMES = (
    "WITH RECURSIVE "
    + _VACANCY_KEYS_SQL
    + r""", pts AS (SELECT *, CAST({points} AS INTEGER) AS points FROM vkeys),
    fresh AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-20 12:00:00') - epoch_us(CAST(posted AS TIMESTAMP))) / 8.64e10 <= 40 AS in_time FROM pts WHERE language <> 'en'),
    inc AS (SELECT * FROM fresh WHERE in_time), sto AS (SELECT * FROM pts WHERE language = 'en'),
    firsts AS (SELECT ord, min(ord) OVER (PARTITION BY k_url) AS f FROM inc UNION ALL SELECT ord, min(ord) OVER (PARTITION BY k_identity) FROM inc WHERE k_identity IS NOT NULL
      UNION ALL SELECT ord, min(ord) OVER (PARTITION BY k_ctl) FROM inc WHERE k_ctl IS NOT NULL),
    edges AS (SELECT DISTINCT ord AS a, f AS b FROM firsts WHERE ord <> f UNION SELECT DISTINCT f, ord FROM firsts WHERE ord <> f),
    reach(node, top) AS (SELECT ord, ord FROM inc UNION SELECT e.b, r.top FROM reach r JOIN edges e ON e.a = r.node WHERE r.top < e.b),
    comps AS (SELECT node, min(top) AS component FROM reach GROUP BY node),
    surv AS (SELECT component, arg_max(ord, CAST(points AS BIGINT) * 1000000000 - ord) AS survivor FROM comps JOIN inc ON node = ord GROUP BY 1),
    """
    + _MATCH_SQL
    + """, outcomes AS (SELECT f.ord, f.company, f.points, b.stored AS match, CASE WHEN NOT in_time THEN 'date_rejected' WHEN survivor <> f.ord THEN 'duplicate_in_run'
      WHEN b.a IS NOT NULL THEN 'already_known' ELSE 'new' END AS outcome
      FROM fresh f LEFT JOIN comps ON node = f.ord LEFT JOIN surv USING (component) LEFT JOIN best b ON b.a = f.ord)
"""
).replace("{points}", _POINTS_SQL)

ORACLES = {
    "crawl_statistics": """WITH r AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS site, url, CASE WHEN page_id % 3 <> 0 THEN regexp_replace(url, '[?#].*$', '') END AS identity,
        (['ok', 'redirect', 'failed', 'http_error', 'skipped'])[CAST(page_id % 5 AS INTEGER) + 1] AS st, page_id % 7 <> 0 AS att, page_id % 100 AS sc, page_id FROM pages)
      SELECT site, count(DISTINCT url) AS requests_queued, count(*) FILTER (att) AS requests_started, count(*) FILTER (att AND st IN ('ok', 'redirect')) AS requests_succeeded,
        count(*) FILTER (att AND st IN ('failed', 'http_error')) AS requests_failed, count(*) AS candidates, count(DISTINCT coalesce(identity, url)) AS identities,
        count(*) - count(DISTINCT coalesce(identity, url)) AS identity_duplicates, count(*) FILTER (sc >= 60) AS high_confidence, count(*) FILTER (sc BETWEEN 20 AND 59) AS medium_confidence,
        count(*) FILTER (sc < 20) AS low_confidence, count(*) FILTER (page_id % 4 = 0) AS known, count(*) FILTER (page_id % 4 <> 0) AS "new", count(*) FILTER (page_id % 8 = 0) AS unchanged,
        count(*) FILTER (NOT att) AS remaining FROM r GROUP BY 1""",
    "crawler_health": """WITH h AS (SELECT event_id % 5 = 0 AS phase, event_id % 3 = 1 AS failed, event_id % 4 AS pages FROM events)
      SELECT CASE WHEN phase AND pages > 0 THEN 'partial' WHEN phase OR (failed AND pages = 0) THEN 'failed' ELSE 'as it is' END AS health, count(*) AS crawls FROM h GROUP BY 1""",
    "tally_assessments": """WITH a AS (SELECT 'site' || p_partkey % 6 AS site, CASE p_partkey % 5 WHEN 1 THEN 'overview' WHEN 2 THEN 'general' ELSE 'detail' END AS kind, p_partkey % 10 = 1 AS rej, p_partkey % 3 AS loc,
        CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 10 END AS code FROM part),
      o AS (SELECT *, CASE WHEN kind <> 'detail' THEN CASE WHEN rej THEN 'no_deadline' ELSE 'not_a_tender' END WHEN loc = 1 THEN 'foreign_country' WHEN code IS NOT NULL AND code NOT IN (5, 1) THEN 'cpv_mismatch' ELSE 'accepted' END AS outcome FROM a),
      r AS (SELECT site, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS reasons FROM (SELECT site, outcome, count(*) AS n FROM o WHERE outcome <> 'accepted' GROUP BY 1, 2) GROUP BY 1)
      SELECT site, count(*) AS assessed, count(*) FILTER (kind = 'overview') AS overview, count(*) FILTER (kind = 'general') AS general, count(*) FILTER (outcome <> 'accepted') AS rejected,
        count(*) FILTER (outcome = 'cpv_mismatch') AS filtered_by_cpv, count(*) FILTER (outcome = 'accepted' AND code IS NULL) AS cpv_unknown, count(*) FILTER (outcome = 'accepted') AS accepted, any_value(reasons) AS reasons
      FROM o LEFT JOIN r USING (site) GROUP BY 1""",
    "tender_run_statistics": """WITH t AS (SELECT o_orderkey % 7 AS run, o_orderkey % 3 = 2 AS web, o_orderkey % 4 AS st, o_orderkey % 2 = 0 AS conf, CAST(o_orderkey % 90 + 10 AS VARCHAR) AS code, o_orderkey % 21 AS src FROM orders),
      s AS (SELECT *, st IN (0, 3) AS opened, (code LIKE '45%' OR code LIKE '7%') AS fits FROM t)
      SELECT run, count(*) AS tenders, count(*) FILTER (NOT web) AS official, count(*) FILTER (web) AS web, count(*) FILTER (opened) AS "open", count(*) FILTER (st = 1) AS expired, count(*) FILTER (st = 2) AS "unknown",
        count(*) FILTER (opened AND (NOT web OR (conf AND fits))) AS open_relevant, CASE WHEN count(*) FILTER (opened AND (NOT web OR (conf AND fits))) > 0 THEN 'open_matches' ELSE 'no_confirmed_open_matches' END AS yield,
        bool_and(run <> 3 AND src <> 8) AS coverage_complete FROM s GROUP BY 1""",
    "company_run_statistics": """WITH c AS (SELECT c_nationkey AS run, count(*) AS companies, count(*) FILTER (c_custkey % 4 = 0) AS confirmed, count(*) FILTER (c_custkey % 4 IN (1, 3)) AS possible, count(*) FILTER (c_custkey % 4 = 2) AS insufficient
        FROM customer WHERE c_nationkey % 5 <> 4 GROUP BY 1),
      s AS (SELECT n_nationkey AS k, concat_ws('; ', CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 3 || ' website(s) konden niet worden gelezen' END, CASE WHEN n_nationkey % 2 > 0 THEN '1 website(s) niet volledig doorlopen' END,
          CASE WHEN n_nationkey % 6 = 0 THEN '4 kandidaat-bedrijven wachten op een vervolgbatch' END, CASE WHEN n_nationkey % 7 = 0 THEN 'tijdslimiet bereikt' END) AS r FROM nation)
      SELECT k AS run, coalesce(companies, 0) AS companies, coalesce(confirmed, 0) AS confirmed, coalesce(possible, 0) AS possible, coalesce(insufficient, 0) AS insufficient, r AS incomplete_reasons, r = '' AS coverage_complete,
        CASE WHEN companies IS NULL THEN 'no_matches' WHEN confirmed > 0 THEN 'confirmed_matches' ELSE 'possible_matches_only' END AS yield FROM s LEFT JOIN c ON run = k""",
    "continuation_claim": """SELECT event_id, user_id AS continues, event_id % 4 <> 1 AND row_number() OVER (PARTITION BY user_id, event_id % 4 = 1 ORDER BY ts, event_id) = 1 AS claims FROM events WHERE event_id % 3 <> 0""",
    "enrichment_budget": "WITH "
    + FACTS_SQL
    + """, g AS (SELECT *, ord % 3 = 0 AND sum(CASE WHEN ord % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY company ORDER BY ord) <= 5 AS granted FROM facts)
      SELECT g.ord, g.granted, coalesce(g.location, CASE WHEN g.granted THEN p.language END) AS location, coalesce(g.salary, CASE WHEN g.granted AND p.ord IS NOT NULL THEN 'page' END) AS salary
      FROM g LEFT JOIN facts p ON p.ord = g.ord + 1""",
    "company_candidates": r"""WITH h AS (SELECT page_id, page_id % 4 AS hits, string_split(regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www[0-9]?\.', ''), '.') AS l FROM pages),
      d AS (SELECT page_id, hits, page_id % 13 || '.' || CASE WHEN len(l) <= 2 THEN array_to_string(l, '.') ELSE l[len(l) - 1] || '.' || l[len(l)] END AS domain FROM h),
      g AS (SELECT domain, count(*) AS results, max(hits) AS hits, CAST(min(page_id) AS VARCHAR) AS title, min(page_id) AS first FROM d GROUP BY 1)
      SELECT domain, results, hits, title, CAST(row_number() OVER (ORDER BY hits DESC, results DESC, first) AS INTEGER) AS place FROM g WHERE length(domain) % 3 <> 0 QUALIFY place <= 25""",
    "search_candidates": "SELECT page_id, page_id % 40 + 6 * (page_id % 5) AS score FROM pages ORDER BY score DESC, page_id LIMIT 50",
    "publications_to_add": """WITH n AS (SELECT l_orderkey, l_partkey, bool_or(l_linenumber % 2 = 0) AS before FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, CAST(count(*) FILTER (NOT before) AS INTEGER) AS new_publications, CAST(count(*) FILTER (NOT before) AS INTEGER) AS rows FROM n GROUP BY 1""",
    "vacancy_duplicates": "WITH "
    + _VACANCY_KEYS_SQL
    + """, hits AS (
      SELECT x.ord a, y.ord b, 'sourceUrl' signal, 100 points, 0 r FROM vkeys x JOIN vkeys y ON x.k_url = y.k_url AND x.ord < y.ord
      UNION ALL SELECT x.ord, y.ord, 'stableJobIdentity', 100, 1 FROM vkeys x JOIN vkeys y ON x.k_identity = y.k_identity AND x.ord < y.ord
      UNION ALL SELECT x.ord, y.ord, 'companyTitleLocation', 95, 2 FROM vkeys x JOIN vkeys y ON x.k_ctl = y.k_ctl AND x.ord < y.ord
      UNION ALL SELECT x.ord, y.ord, 'companyTitle', 50, 3 FROM vkeys x JOIN vkeys y ON x.k_ct = y.k_ct AND x.ord < y.ord),
    pairs AS (SELECT a, b, CAST(least(100, sum(points)) AS INTEGER) AS score, string_agg(signal, ',' ORDER BY r) AS signals FROM hits GROUP BY a, b)
    SELECT *, CASE WHEN score >= 90 THEN 'duplicate' ELSE 'possible_duplicate' END AS decision FROM pairs""",
    "match_existing_by_any_key": "WITH "
    + _VACANCY_KEYS_SQL
    + ", inc AS (SELECT * FROM vkeys WHERE language <> 'en'), sto AS (SELECT * FROM vkeys WHERE language = 'en'), "
    + _MATCH_SQL
    + "SELECT a AS doc_id, score, stored FROM best",
    "vacancy_outcomes": _OUTCOMES + "SELECT * FROM outcomes",
    "vacancy_run": _OUTCOMES
    + """, f AS (SELECT company AS site, ord % 9 <> 0 AS rel, outcome, row_number() OVER (PARTITION BY company, outcome ORDER BY points DESC, ord) <= 20 AS stored FROM outcomes),
    c AS (SELECT site, count(*) AS n, count(*) FILTER (NOT rel) AS rbr, count(*) FILTER (rel) AS r, count(*) FILTER (rel AND outcome = 'date_rejected') AS rd,
      count(*) FILTER (rel AND outcome = 'duplicate_in_run') AS dr, count(*) FILTER (rel AND outcome = 'already_known') AS ak, count(*) FILTER (rel AND outcome = 'new' AND NOT stored) AS ct,
      count(*) FILTER (rel AND outcome = 'new' AND stored) AS nr FROM f GROUP BY 1)
    SELECT site AS provider, CAST(sum(n + 3) AS BIGINT) AS discovered, CAST(sum(2) AS BIGINT) AS not_processed, CAST(sum(1) AS BIGINT) AS no_usable_data, CAST(sum(rbr) AS BIGINT) AS rejected_by_relevance,
      CAST(sum(r) AS BIGINT) AS relevant, CAST(sum(rd) AS BIGINT) AS rejected_by_date, CAST(sum(dr) AS BIGINT) AS duplicates_in_run, CAST(sum(ak) AS BIGINT) AS already_known,
      CAST(sum(ct) AS BIGINT) AS cut_by_target, CAST(sum(nr) AS BIGINT) AS new_records, CAST(0 AS BIGINT) AS multi_record_extra FROM c GROUP BY ROLLUP (site)""",
}
