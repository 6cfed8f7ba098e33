"""Scoring, duplicates, outcomes and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.dates import within_days
from gleaner.functions.text import dedupe_key
from gleaner.operators import dedupe, funnel, merge
from gleaner.operators.scoring import Rule, present_and_missing, score

from .tables import FACTS_SQL, document_facts, table

NOW = "2024-02-20 12:00:00"

#: Completeness: presence of each field, points summing to 100.
def completeness_rules() -> list[Rule]:
    c = F.col
    return [
        Rule("title", c("title").isNotNull(), 20),
        Rule("company", c("company").isNotNull(), 15),
        Rule("location", c("location").isNotNull(), 15),
        Rule("description", c("description").isNotNull(), 20),
        Rule("salary", c("salary").isNotNull(), 10),
        Rule("directContact", c("phone").isNotNull() | c("email").isNotNull(), 15),
        Rule("sourceUrl", c("source_url").isNotNull(), 5),
    ]


def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = completeness_rules()
    present, missing = present_and_missing([(r.id, r.applies) for r in rules])
    return document_facts(spark, sf_dir).select(
        F.col("ord").alias("doc_id"),
        score(rules)["score"].alias("score"),
        F.array_join(present, ",").alias("present"),
        F.array_join(missing, ",").alias("missing"),
    )


_POINTS_SQL = """(CASE WHEN title IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN company IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN location IS NOT NULL THEN 15 ELSE 0 END
    + CASE WHEN description IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN salary IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN phone IS NOT NULL OR email IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN source_url IS NOT NULL THEN 5 ELSE 0 END)"""
_SIGNALS = [
    ("title", "title IS NOT NULL"), ("company", "company IS NOT NULL"), ("location", "location IS NOT NULL"), ("description", "description IS NOT NULL"),
    ("salary", "salary IS NOT NULL"), ("directContact", "(phone IS NOT NULL OR email IS NOT NULL)"), ("sourceUrl", "source_url IS NOT NULL"),
]


def _named(yes: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {yes} {c} THEN '{n}' END" for n, c in _SIGNALS) + ")"


def signed_reasons_with_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for and against customers; those of nation 3 have at most 50."""
    rules = [
        Rule("in_credit", F.col("c_acctbal") > 0, 40),
        Rule("in_debt", F.col("c_acctbal") < 0, -20),
        Rule("builder", F.col("c_mktsegment") == "BUILDING", 75),
        Rule("near", F.col("c_nationkey") < 5, 0),
    ]
    s = score(rules, cap=lambda raw: F.when(F.col("c_nationkey") == 3, F.least(raw, F.lit(50))).otherwise(raw))
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("s")).select(
        "c_custkey",
        F.col("s.score").alias("score"),
        F.array_join("s.fired", ",").alias("fired"),
        F.array_join("s.positive", ",").alias("positive"),
        F.array_join("s.negative", ",").alias("negative"),
    )


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    pairs = dedupe.duplicate_pairs(docs, [dedupe.ExactSignal("text", 100, F.sha2("text", 256))], 90, 40)
    return pairs.select("a", "b", "score", "decision")


def _signals() -> list[dedupe.ExactSignal]:
    title, company, place = dedupe_key(F.col("title")), dedupe_key(F.col("company")), dedupe_key(F.col("location"))
    return [
        dedupe.ExactSignal("sourceUrl", 100, F.col("source_url")),
        dedupe.ExactSignal("companyTitleLocation", 95, F.concat(company, F.lit("|"), title, F.lit("|"), place)),
        dedupe.ExactSignal("companyTitle", 50, F.concat(company, F.lit("|"), title)),
    ]


def multi_signal_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedupe.duplicate_pairs(document_facts(spark, sf_dir), _signals(), 90, 40, names=("duplicate", "possible_duplicate"))
    return pairs.select("a", "b", "score", F.array_join("signals", ",").alias("signals"), "decision")


_PAIRS_SQL = (
    "WITH "
    + FACTS_SQL
    + r""", keyed AS (SELECT ord, source_url,
      lower(trim(regexp_replace(company, '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS ct,
      lower(trim(regexp_replace(company, '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) || '|' || lower(trim(location)) AS ctl
      FROM facts),
    hits AS (
      SELECT x.ord a, y.ord b, 'sourceUrl' signal, 100 points, 0 r FROM keyed x JOIN keyed y ON x.source_url = y.source_url AND x.ord < y.ord
      UNION ALL SELECT x.ord, y.ord, 'companyTitleLocation', 95, 1 FROM keyed x JOIN keyed y ON x.ctl = y.ctl AND x.ord < y.ord
      UNION ALL SELECT x.ord, y.ord, 'companyTitle', 50, 2 FROM keyed x JOIN keyed y ON x.ct = y.ct AND x.ord < y.ord),
    pairs AS (SELECT a, b, CAST(least(100, sum(points)) AS INTEGER) AS score, string_agg(signal, ',' ORDER BY r) AS signals FROM hits GROUP BY a, b)
"""
)


def distance_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, placed by their key, within 900 metres of each other."""
    key = F.col("s_suppkey")
    placed = table(spark, sf_dir, "supplier").select(
        key.alias("ord"), (F.lit(52.0) + (key % 10) * 0.005).alias("lat"), (F.lit(5.0) + (key % 7) * 0.01).alias("lon")
    )
    near = dedupe.DistanceSignal("near", 60, 900.0, F.col("lat"), F.col("lon"))
    return dedupe.duplicate_pairs(placed, [near], 90, 40).select("a", "b", "score", "decision")


def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by equal text or equal URL; component is the smallest doc_id."""
    facts = document_facts(spark, sf_dir)
    linked = dedupe.collapse_by_key(facts, [F.col("source_url"), F.sha2("description", 256)])
    return dedupe.collapse(facts, linked, F.lit(0)).select(F.col("ord").alias("doc_id"), "component")


_COMPONENTS_SQL = (
    "WITH RECURSIVE "
    + FACTS_SQL
    + """, firsts AS (
      SELECT ord, min(ord) OVER (PARTITION BY source_url) AS f FROM facts
      UNION ALL SELECT ord, min(ord) OVER (PARTITION BY description) FROM facts WHERE description IS NOT NULL),
    edges AS (SELECT DISTINCT ord AS a, f AS b FROM firsts WHERE ord <> f UNION SELECT DISTINCT f, ord FROM firsts WHERE ord <> f),
    reach(node, top) AS (SELECT ord, ord FROM facts UNION SELECT e.b, r.top FROM reach r JOIN edges e ON e.a = r.node WHERE r.top < e.b),
    comps AS (SELECT node, min(top) AS component FROM reach GROUP BY node)
"""
)


def collapse_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most complete record of each component, the earliest of equals."""
    facts = document_facts(spark, sf_dir).withColumn("points", score(completeness_rules())["score"])
    linked = dedupe.collapse_by_key(facts, [F.col("source_url"), F.sha2("description", 256)])
    grouped = dedupe.collapse(facts, linked, F.col("points"))
    return grouped.groupBy("component", "survivor").agg(F.count(F.lit(1)).alias("members"), F.max("points").alias("points"))


def record_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each incoming record: too old, a duplicate in the run, known already, or new.

    English records are stored, the others come in; a stored record of the same URL makes one known.
    """
    facts = document_facts(spark, sf_dir)
    stored, fresh = facts.where("language = 'en'"), facts.where("language <> 'en'")
    fresh = fresh.withColumn("in_time", within_days(F.col("posted"), F.lit(NOW).cast("timestamp"), 40))
    timely = fresh.where("in_time")
    linked = dedupe.collapse_by_key(timely, [F.col("source_url"), F.sha2("description", 256)])
    survivors = dedupe.collapse(timely, linked, F.lit(0)).select(F.col("ord").alias("o"), "survivor")
    known = stored.select(F.col("source_url").alias("known_url")).distinct()
    joined = fresh.join(survivors, F.col("ord") == F.col("o"), "left").join(known, F.col("source_url") == F.col("known_url"), "left")
    outcome = (
        F.when(~F.col("in_time"), F.lit("date_rejected"))
        .when(F.col("survivor") != F.col("ord"), F.lit("duplicate_in_run"))
        .when(F.col("known_url").isNotNull(), F.lit("already_known"))
        .otherwise(F.lit("new"))
    )
    return joined.select(F.col("ord").alias("doc_id"), outcome.alias("outcome"))


_OUTCOMES_SQL = (
    "WITH RECURSIVE "
    + FACTS_SQL
    + """, fresh AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-20 12:00:00') - epoch_us(CAST(posted AS TIMESTAMP))) / 8.64e10 <= 40 AS in_time FROM facts WHERE language <> 'en'),
    timely AS (SELECT * FROM fresh WHERE in_time),
    firsts AS (
      SELECT ord, min(ord) OVER (PARTITION BY source_url) AS f FROM timely
      UNION ALL SELECT ord, min(ord) OVER (PARTITION BY description) FROM timely WHERE description IS NOT NULL),
    edges AS (SELECT DISTINCT ord AS a, f AS b FROM firsts WHERE ord <> f UNION SELECT DISTINCT f, ord FROM firsts WHERE ord <> f),
    reach(node, top) AS (SELECT ord, ord FROM timely UNION SELECT e.b, r.top FROM reach r JOIN edges e ON e.a = r.node WHERE r.top < e.b),
    comps AS (SELECT node, min(top) AS component FROM reach GROUP BY node),
    outcomes AS (SELECT f.ord AS doc_id, CASE WHEN NOT in_time THEN 'date_rejected' WHEN component <> f.ord THEN 'duplicate_in_run'
      WHEN f.source_url IN (SELECT source_url FROM facts WHERE language = 'en') THEN 'already_known' ELSE 'new' END AS outcome
      FROM fresh f LEFT JOIN comps ON node = f.ord)
"""
)


def run_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of a run by provider and in total: documents as facts, sources as providers."""
    d = table(spark, sf_dir, "documents")
    outcome = F.get(F.array(*(F.lit(x) for x in ("new", "date_rejected", "duplicate_in_run", "already_known", "new"))), (F.col("doc_id") % 5).cast("int"))
    facts = d.select(
        F.when(F.col("doc_id") % 97 != 0, F.col("source")).alias("site"),
        (F.col("lang") == "en").alias("relevant"),
        outcome.alias("outcome"),
        (F.col("doc_id") % 3 != 0).alias("stored"),
    )
    n = F.count(F.lit(1))
    sites = d.groupBy(F.col("source").alias("site")).agg(
        (n + 5).alias("discovered"), (n + 2).alias("attempted"), (n - F.max("doc_id") % 4).alias("with_data")
    )
    return funnel.run_breakdown(sites, facts)


_BREAKDOWN_SQL = """
WITH f AS (SELECT CASE WHEN doc_id % 97 <> 0 THEN source ELSE 'unknown' END AS site, lang = 'en' AS rel,
    (['new', 'date_rejected', 'duplicate_in_run', 'already_known', 'new'])[CAST(doc_id % 5 AS INTEGER) + 1] AS outcome, doc_id % 3 <> 0 AS stored FROM documents),
 s AS (SELECT source AS site, count(*) + 5 AS discovered, count(*) + 2 AS attempted, count(*) - max(doc_id) % 4 AS with_data FROM documents GROUP BY 1),
 c AS (SELECT site, count(*) AS facts, count(*) FILTER (NOT rel) AS rbr, count(*) FILTER (rel) AS r,
    count(*) FILTER (rel AND outcome = 'date_rejected') AS rd, count(*) FILTER (rel AND outcome = 'duplicate_in_run') AS dr,
    count(*) FILTER (rel AND outcome = 'already_known') AS ak, count(*) FILTER (rel AND outcome = 'new' AND NOT stored) AS ct,
    count(*) FILTER (rel AND outcome = 'new' AND stored) AS nr FROM f GROUP BY 1),
 e AS (SELECT coalesce(s.site, c.site) AS provider, coalesce(discovered, 0) AS discovered, greatest(0, coalesce(discovered - attempted, 0)) AS not_processed,
    greatest(0, coalesce(attempted - with_data, 0)) AS no_usable_data, coalesce(rbr, 0) AS rejected_by_relevance, coalesce(r, 0) AS relevant, coalesce(rd, 0) AS rejected_by_date,
    coalesce(dr, 0) AS duplicates_in_run, coalesce(ak, 0) AS already_known, coalesce(ct, 0) AS cut_by_target, coalesce(nr, 0) AS new_records,
    greatest(0, coalesce(facts, 0) - coalesce(with_data, 0)) AS multi_record_extra FROM s FULL OUTER JOIN c ON s.site = c.site)
SELECT provider, CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(not_processed) AS BIGINT) AS not_processed, CAST(sum(no_usable_data) AS BIGINT) AS no_usable_data,
  CAST(sum(rejected_by_relevance) AS BIGINT) AS rejected_by_relevance, CAST(sum(relevant) AS BIGINT) AS relevant, CAST(sum(rejected_by_date) AS BIGINT) AS rejected_by_date,
  CAST(sum(duplicates_in_run) AS BIGINT) AS duplicates_in_run, CAST(sum(already_known) AS BIGINT) AS already_known, CAST(sum(cut_by_target) AS BIGINT) AS cut_by_target,
  CAST(sum(new_records) AS BIGINT) AS new_records, CAST(sum(multi_record_extra) AS BIGINT) AS multi_record_extra
FROM e GROUP BY ROLLUP (provider)
"""


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return funnel.source_status(events, "event_type", F.col("value") < 20, F.floor("value")).withColumnRenamed("event_type", "source")


def posted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last 400 days before mid 1997; unknown dates (every tenth order) stay."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))
    return o.where(within_days(F.col("day"), F.lit("1997-07-01 06:00:00").cast("timestamp_ntz"), 400)).select("o_orderkey", "day")


def latest_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the latest value that is known, and the latest event as it is."""
    e = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind")
    )
    return merge.latest_non_null(e, ["user_id"], F.struct("ts", "event_id"), ["value"], ["kind", "event_id"])


def publication_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as publications of a customer: how many, the latest, and the price of the latest urgent one."""
    o = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.col("o_orderkey").cast("string").alias("publication"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).alias("urgent_price"),
    )
    order = merge.publication_order(F.col("day"), F.col("publication"))
    counted = o.groupBy("o_custkey").agg(F.countDistinct("publication").alias("publications"))
    return merge.latest_non_null(o, ["o_custkey"], order, ["urgent_price"], ["publication", "day"]).join(counted, "o_custkey")


def upsert_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after 1996 against those before, one row of each customer a side: new, updated or unchanged."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"), "o_orderdate")
    incoming = (
        o.where("o_orderdate >= timestamp_ntz'1997-01-01'")
        .withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())))
        .where("n = 1")
        .select("o_custkey", "o_orderkey", "o_orderstatus", "priority")
    )
    stored = o.where("o_orderdate < timestamp_ntz'1997-01-01'").select("o_custkey", "o_orderkey", "o_orderstatus", "priority")
    return merge.split_upsert(stored, incoming, "o_custkey", ["o_orderstatus", "priority"], "o_orderkey")


def stored_identity_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated stored identities one domain keeps the first, another the last."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_kept"), F.max("o_orderkey").alias("last_kept"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))


def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every record, gaps filled from the record 100 places on."""
    f = document_facts(spark, sf_dir).select("ord", "location", "salary", "email", "phone")
    other = f.withColumn("ord", F.col("ord") - 100)
    return merge.fill_missing(f, other, "ord", ["location", "salary", "email", "phone"]).withColumnRenamed("ord", "doc_id")


QUERIES = {
    "completeness_score": completeness_score,
    "signed_reasons_with_cap": signed_reasons_with_cap,
    "exact_duplicates": exact_duplicates,
    "multi_signal_duplicates": multi_signal_duplicates,
    "distance_duplicates": distance_duplicates,
    "duplicate_components": duplicate_components,
    "collapse_survivors": collapse_survivors,
    "record_outcomes": record_outcomes,
    "run_breakdown": run_breakdown,
    "source_coverage": source_coverage,
    "posted_window": posted_window,
    "latest_non_null": latest_non_null,
    "publication_history": publication_history,
    "upsert_split": upsert_split,
    "stored_identity_first_last": stored_identity_first_last,
    "fill_missing": fill_missing,
}

ORACLES = {
    "completeness_score": f"WITH {FACTS_SQL} SELECT ord AS doc_id, CAST({_POINTS_SQL} AS INTEGER) AS score, {_named('')} AS present, {_named('NOT')} AS missing FROM facts",
    "signed_reasons_with_cap": """
      WITH r AS (SELECT *, c_acctbal > 0 AS ic, c_acctbal < 0 AS ind, c_mktsegment = 'BUILDING' AS bu, c_nationkey < 5 AS ne FROM customer),
      t AS (SELECT *, least(100, greatest(0, CASE WHEN ic THEN 40 ELSE 0 END - CASE WHEN ind THEN 20 ELSE 0 END + CASE WHEN bu THEN 75 ELSE 0 END)) AS raw FROM r)
      SELECT c_custkey, CAST(CASE WHEN c_nationkey = 3 THEN least(raw, 50) ELSE raw END AS INTEGER) AS score,
        concat_ws(',', CASE WHEN ic THEN 'in_credit' END, CASE WHEN ind THEN 'in_debt' END, CASE WHEN bu THEN 'builder' END, CASE WHEN ne THEN 'near' END) AS fired,
        concat_ws(',', CASE WHEN ic THEN 'in_credit' END, CASE WHEN bu THEN 'builder' END) AS positive,
        concat_ws(',', CASE WHEN ind THEN 'in_debt' END) AS negative FROM t""",
    "exact_duplicates": "SELECT x.doc_id AS a, y.doc_id AS b, CAST(100 AS INTEGER) AS score, 'strong_match' AS decision FROM documents x JOIN documents y ON x.text = y.text AND x.doc_id < y.doc_id",
    "multi_signal_duplicates": _PAIRS_SQL + "SELECT a, b, score, signals, CASE WHEN score >= 90 THEN 'duplicate' ELSE 'possible_duplicate' END AS decision FROM pairs WHERE score >= 40",
    "distance_duplicates": """
      WITH p AS (SELECT s_suppkey AS ord, 52.0 + (s_suppkey % 10) * 0.005 AS lat, 5.0 + (s_suppkey % 7) * 0.01 AS lon FROM supplier),
      d AS (SELECT x.ord AS a, y.ord AS b, 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(y.lat - x.lat) / 2), 2)
        + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))) AS m
        FROM p x JOIN p y ON x.ord < y.ord AND abs(floor(x.lat / 0.01) - floor(y.lat / 0.01)) <= 1 AND abs(floor(x.lon / 0.01) - floor(y.lon / 0.01)) <= 1)
      SELECT a, b, CAST(60 AS INTEGER) AS score, 'possible_duplicate' AS decision FROM d WHERE m <= 900""",
    "duplicate_components": _COMPONENTS_SQL + "SELECT node AS doc_id, component FROM comps",
    "collapse_survivors": _COMPONENTS_SQL
    + f", scored AS (SELECT component, ord, {_POINTS_SQL} AS p FROM facts JOIN comps ON node = ord) "
    + "SELECT component, arg_max(ord, CAST(p AS BIGINT) * 1000000000 - ord) AS survivor, count(*) AS members, CAST(max(p) AS INTEGER) AS points FROM scored GROUP BY component",
    "record_outcomes": _OUTCOMES_SQL + "SELECT * FROM outcomes",
    "run_breakdown": _BREAKDOWN_SQL,
    "source_coverage": """SELECT event_type AS source, count(*) AS requests, count(*) FILTER (value < 20) AS failures, CAST(sum(floor(value)) AS BIGINT) AS returned,
      CASE WHEN count(*) FILTER (value >= 20) = 0 THEN 'failed' WHEN count(*) FILTER (value < 20) > 0 THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY 1""",
    "posted_window": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS day FROM orders)
      SELECT * FROM o WHERE day IS NULL OR (epoch_us(TIMESTAMP '1997-07-01 06:00:00') - epoch_us(day)) / 8.64e10 <= 400""",
    "latest_non_null": """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events),
      l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e),
      v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM e WHERE value IS NOT NULL)
      SELECT l.user_id, v.value, l.kind, l.event_id FROM l LEFT JOIN v ON v.user_id = l.user_id AND v.n = 1 WHERE l.n = 1""",
    "publication_history": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS n FROM orders),
      u AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderpriority = '1-URGENT'),
      c AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS publications FROM orders GROUP BY 1)
      SELECT l.o_custkey, u.o_totalprice AS urgent_price, CAST(l.o_orderkey AS VARCHAR) AS publication, strftime(l.o_orderdate, '%Y-%m-%d') AS day, publications
      FROM l JOIN c ON c.o_custkey = l.o_custkey LEFT JOIN u ON u.o_custkey = l.o_custkey AND u.n = 1 WHERE l.n = 1""",
    "upsert_split": """WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS priority, o_orderdate FROM orders),
      i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM o WHERE o_orderdate >= TIMESTAMP '1997-01-01') WHERE n = 1),
      s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM o WHERE o_orderdate < TIMESTAMP '1997-01-01') WHERE n = 1)
      SELECT i.o_custkey, i.o_orderkey, coalesce(i.o_orderstatus, s.o_orderstatus) AS o_orderstatus, coalesce(i.priority, s.priority) AS priority,
        CASE WHEN s.o_custkey IS NULL THEN 'new' WHEN (i.o_orderstatus IS NOT NULL AND i.o_orderstatus IS DISTINCT FROM s.o_orderstatus)
          OR (i.priority IS NOT NULL AND i.priority IS DISTINCT FROM s.priority) THEN 'updated' ELSE 'unchanged' END AS action, s.o_orderkey AS stored_order
      FROM i LEFT JOIN s ON s.o_custkey = i.o_custkey""",
    "stored_identity_first_last": "SELECT o_custkey, min(o_orderkey) AS first_kept, max(o_orderkey) AS last_kept, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1",
    "fill_missing": f"""WITH {FACTS_SQL} SELECT a.ord AS doc_id, coalesce(a.location, b.location) AS location, coalesce(a.salary, b.salary) AS salary, coalesce(a.email, b.email) AS email,
      coalesce(a.phone, b.phone) AS phone FROM facts a LEFT JOIN facts b ON b.ord - 100 = a.ord""",
}
