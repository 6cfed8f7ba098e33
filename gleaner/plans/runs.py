"""Whole runs as one plan each: collect, merge, gate, match with what is stored, cut at the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import url as U
from gleaner.operators import matching, merge
from gleaner.operators.relevance import keyword_hits

from .tables import table


def cut_at_target(rows: DataFrame, order: list, target: int) -> DataFrame:
    """The first ``target`` rows that are new, and all others; ``kept`` tells them apart.

    Only the new rows' numbers are counted: the boundary is one row, found by a bounded top-k.
    """
    new = rows.where("action = 'new'")
    first = new.orderBy(*order).limit(target).select("record", F.lit(True).alias("in_target"))
    return rows.join(F.broadcast(first), "record", "left").select(  # as many rows as the target
        *rows.columns, ((F.col("action") != "new") | F.coalesce("in_target", F.lit(False))).alias("kept")
    )


def tender_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications (lines) of tenders (orders): one record a tender, those on a subject, against what is stored.

    Official sources (flag R) come first; at most 200 new records are kept.
    """
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("day"), F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    publications = l.join(p, F.col("part") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("record"),
        F.struct("day", "l_linenumber").alias("at"),
        F.when(F.col("quantity") > 10, F.lower("p_type")).alias("title"),
        F.when(F.col("quantity") < 30, F.col("quantity")).alias("amount"),
        "flag",
    )
    merged = merge.latest_non_null(publications, ["record"], F.col("at"), ["title", "amount"], ["flag"])
    on_subject = merged.where(keyword_hits(F.coalesce("title", F.lit("")), ["brushed", "economy"]) > 0)
    stored = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("record"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("amount"), F.col("o_orderstatus").alias("flag"), F.col("o_orderkey").alias("ord")
    )
    split = merge.split_upsert(stored, on_subject, "record", ["title", "amount"], "ord").drop("stored_order")
    return cut_at_target(split, [F.when(F.col("flag") == "R", 0).otherwise(1), "record"], 200)


def company_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host as companies: evidence for three criteria, verdict, and the best hundred that are not insufficient."""
    p = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("company"), "page_id", F.lower("html").alias("low"), F.regexp_extract("url", "://[^/]*/([a-z]{2})/", 1).alias("lang"))
    kinds = F.explode(
        F.array(
            F.struct(F.lit("activity").alias("kind"), F.regexp_count("low", F.lit("thation")).alias("hits")),
            F.struct(F.lit("sector").alias("kind"), F.regexp_count("low", F.lit("erther")).alias("hits")),
            F.struct(F.lit("place").alias("kind"), F.when(F.col("lang") == "en", 3).otherwise(0).alias("hits")),
        )
    )
    status = F.when(F.col("k.hits") >= 3, F.lit("confirmed")).when(F.col("k.hits") >= 1, F.lit("possible")).otherwise(F.lit("insufficient"))
    verdicts = matching.criteria_status(p.select("company", kinds.alias("k")).select("company", "k.kind", status.alias("status")), "company", ["activity", "sector"])
    sizes = p.groupBy("company").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))
    rank = F.when(F.col("status") == "confirmed", 0).otherwise(1)
    return verdicts.join(sizes, "company").where("status <> 'insufficient'").orderBy(rank, F.desc("pages"), "company").limit(100).select("company", "status", "pages", "first_page")


def activity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of suppliers, stored and seen again: strength rises, or is set anew when all its evidence was seen again.

    Evidence are order keys; at most five are kept, stored ones first.
    """
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("activity"), "l_orderkey", "l_quantity", "l_linestatus")
    stored = _activities(l.where("l_linestatus = 'F'"))
    seen = _activities(l.where("l_linestatus = 'O'"))
    s, n = stored.alias("s"), seen.alias("n")
    both = s.join(n, ["l_suppkey", "activity"], "full_outer")
    again = F.size(F.array_except("s.evidence", "n.evidence")) == 0
    strength = (
        F.when(F.col("s.strength").isNull(), F.col("n.strength"))
        .when(F.col("n.strength").isNull(), F.col("s.strength"))
        .when((F.col("n.strength") == "strong") | again, F.col("n.strength"))
        .otherwise(F.col("s.strength"))
    )
    none = F.array().cast("array<bigint>")
    evidence = F.slice(F.array_union(F.coalesce("s.evidence", none), F.coalesce("n.evidence", none)), 1, 5)
    return both.select("l_suppkey", "activity", strength.alias("strength"), F.array_join(evidence, ",").alias("evidence"))


def _activities(rows: DataFrame) -> DataFrame:
    """Strong where any order of the activity is large; evidence are three orders, the largest first."""
    key = ["l_suppkey", "activity"]
    strength = rows.groupBy(*key).agg(F.when(F.max("l_quantity") > 30, F.lit("strong")).otherwise(F.lit("weak")).alias("strength"))
    each = rows.groupBy(*key, "l_orderkey").agg(F.max("l_quantity").alias("q"))
    largest = Window.partitionBy(*key).orderBy(F.desc("q"), "l_orderkey")
    placed = each.withColumn("n", F.row_number().over(largest)).where("n <= 3")  # cut before the shuffle, too
    evidence = placed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "l_orderkey"))), lambda x: x["l_orderkey"]).alias("evidence"))
    return strength.join(evidence, key)


QUERIES = {"tender_run": tender_run, "company_run": company_run, "activity_merge": activity_merge}

ORACLES = {
    "tender_run": r"""
      WITH l AS (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS day, min(l_partkey) AS part, min(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2),
      b AS (SELECT l_orderkey AS record, epoch_us(day) * 100 + l_linenumber AS at_, CASE WHEN quantity > 10 THEN lower(p_type) END AS title, CASE WHEN quantity < 30 THEN quantity END AS amount, flag
        FROM l JOIN part ON p_partkey = part),
      m AS (SELECT record, arg_max(title, at_) FILTER (title IS NOT NULL) AS title, arg_max(amount, at_) FILTER (amount IS NOT NULL) AS amount, arg_max(flag, at_) AS flag FROM b GROUP BY 1),
      w AS (SELECT *, list_filter(string_split(trim(regexp_replace(coalesce(title, ''), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS w FROM m),
      s AS (SELECT record, title, amount, flag FROM w WHERE len(list_filter(w, lambda x: x IN ('brushed', 'economy') OR (length(x) >= 4
        AND (starts_with(x, 'brushed') OR starts_with('brushed', x) OR starts_with(x, 'economy') OR starts_with('economy', x))))) > 0),
      a AS (SELECT s.*, CASE WHEN o_orderkey IS NULL THEN 'new' WHEN title IS NOT NULL OR amount IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action
        FROM s LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = record),
      r AS (SELECT *, row_number() OVER (PARTITION BY action = 'new' ORDER BY CASE WHEN flag = 'R' THEN 0 ELSE 1 END, record) AS n FROM a)
      SELECT record, title, amount, flag, action, action <> 'new' OR n <= 200 AS kept FROM r""",
    "company_run": """
      WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS company, page_id, lower(html) AS low, regexp_extract(url, '://[^/]*/([a-z]{2})/', 1) AS lang FROM pages),
      h AS (SELECT company, page_id, len(regexp_extract_all(low, 'thation')) AS a, len(regexp_extract_all(low, 'erther')) AS s, CASE WHEN lang = 'en' THEN 3 ELSE 0 END AS l FROM p),
      k AS (SELECT company, least(2, CASE WHEN max(a) >= 3 THEN 2 WHEN max(a) >= 1 THEN 1 ELSE 0 END) AS a, CASE WHEN max(s) >= 3 THEN 2 WHEN max(s) >= 1 THEN 1 ELSE 0 END AS s,
        CASE WHEN max(l) >= 3 THEN 2 ELSE 0 END AS l, count(*) AS pages, min(page_id) AS first_page FROM h GROUP BY 1),
      v AS (SELECT *, CASE WHEN least(a, s, l) = 2 THEN 'confirmed' WHEN greatest(a, s) = 0 THEN 'insufficient' ELSE 'possible' END AS status FROM k)
      SELECT company, status, pages, first_page FROM v WHERE status <> 'insufficient' ORDER BY status, pages DESC, company LIMIT 100""",
    "activity_merge": """
      WITH f AS (SELECT l_suppkey, l_returnflag AS activity, l_linestatus AS ls, l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4),
      g AS (SELECT l_suppkey, activity, ls, (list(l_orderkey ORDER BY q DESC NULLS LAST, l_orderkey))[1:3] AS e, CASE WHEN max(q) > 30 THEN 'strong' ELSE 'weak' END AS st FROM f GROUP BY 1, 2, 3),
      s AS (SELECT * FROM g WHERE ls = 'F'), n AS (SELECT * FROM g WHERE ls = 'O')
      SELECT coalesce(s.l_suppkey, n.l_suppkey) AS l_suppkey, coalesce(s.activity, n.activity) AS activity,
        CASE WHEN s.st IS NULL THEN n.st WHEN n.st IS NULL THEN s.st WHEN n.st = 'strong' OR list_has_all(n.e, s.e) THEN n.st ELSE s.st END AS strength,
        array_to_string(list_slice(list_concat(coalesce(s.e, []), list_filter(coalesce(n.e, []), lambda x: NOT list_contains(coalesce(s.e, []), x))), 1, 5), ',') AS evidence
      FROM s FULL OUTER JOIN n ON s.l_suppkey = n.l_suppkey AND s.activity = n.activity""",
}
