"""What held when: versions of customers' priorities over their orders, and orders as a log of publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import publications
from gleaner.operators import versions as V
from gleaner.operators.storage import new_path

from .tables import table


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority and status of each customer's last order of a day."""
    o = table(spark, sf_dir, "orders")
    last = lambda c: F.max_by(c, "o_orderkey").alias(c)
    return o.groupBy("o_custkey", "o_orderdate").agg(last("o_orderpriority"), last("o_orderstatus"))


def record_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line what its customer's latest order said on the day it was shipped."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    asked = lines.select("l_orderkey", "l_linenumber", "o_custkey", "l_shipdate")
    return V.as_of(asked, _priorities(spark, sf_dir), "o_custkey", "l_shipdate", "o_orderdate", ["o_orderpriority", "o_orderstatus"])


def record_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in which a customer's orders had one priority."""
    return V.validity(_priorities(spark, sf_dir).drop("o_orderstatus"), "o_custkey", "o_orderdate", ["o_orderpriority"])


def tender_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tenders and lines as publications, in two runs of a log: what the second makes of the first, after compaction."""
    folder, low = new_path(spark, "log"), lambda c: F.min(c).alias(c)
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(low(c) for c in ("l_shipdate", "l_quantity", "l_extendedprice", "l_partkey", "l_returnflag", "l_linestatus")))

    def run(number: int, which: str, title: Column, discovery: Column) -> None:
        codes = F.when(F.col("l_linestatus") == "O", F.array(F.col("l_partkey").cast("string"))).otherwise(F.array().cast("array<string>"))
        rows = l.where(which).select(
            F.col("l_orderkey").alias("tender"), F.col("l_linenumber").cast("string").alias("publication_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("published"), discovery.alias("discovery"),
            F.when(F.col("l_quantity") > 25, title).alias("title"), codes.alias("codes"),
        )
        publications.append(rows, folder, number)

    said = lambda mark, c: F.concat(F.lit(mark), F.floor(c).cast("string"))
    run(1, "l_linestatus = 'F'", said("q", "l_quantity"), F.col("l_returnflag"))
    run(2, "l_linestatus = 'O' or l_returnflag = 'A'", said("p", "l_extendedprice"), F.lit("again"))
    publications.compact(spark, folder, 1)
    found = publications.update(publications.publications(spark, folder, 1), publications.publications(spark, folder), ["title", "codes"], 2)
    return found.select("tender", "title", F.array_join("codes", ",").alias("codes"), "publication_id", "published", "discovery", F.array_join("publications", ",").alias("publications"), "status", "added")


QUERIES = {"record_as_of": record_as_of, "record_versions": record_versions, "tender_update": tender_update}

_DAYS = "d AS (SELECT o_custkey, o_orderdate, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1, 2)"

ORACLES = {
    "record_as_of": f"""WITH {_DAYS}, q AS (SELECT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT q.*, d.o_orderpriority, d.o_orderstatus FROM q ASOF LEFT JOIN d ON q.o_custkey = d.o_custkey AND q.l_shipdate >= d.o_orderdate""",
    "record_versions": f"""WITH {_DAYS}, c AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS p FROM d)
SELECT o_custkey, o_orderpriority, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_to
FROM c WHERE p IS DISTINCT FROM o_orderpriority""",
    "tender_update": """WITH l AS (SELECT l_orderkey AS t, l_linenumber AS p, strftime(min(l_shipdate), '%Y-%m-%d') AS d, min(l_quantity) AS q, min(l_extendedprice) AS e, min(l_partkey) AS k, min(l_returnflag) AS f, min(l_linestatus) AS s
    FROM lineitem GROUP BY 1, 2),
r AS (SELECT 1 AS run, t, p, d, CASE WHEN q > 25 THEN 'q' || CAST(floor(q) AS BIGINT) END AS title, CAST([] AS VARCHAR[]) AS codes, f AS disc FROM l WHERE s = 'F'
  UNION ALL SELECT 2, t, p, d, CASE WHEN q > 25 THEN 'p' || CAST(floor(e) AS BIGINT) END, CASE WHEN s = 'O' THEN [CAST(k AS VARCHAR)] ELSE [] END, 'again' FROM l WHERE s = 'O' OR f = 'A'),
upto AS (SELECT unnest([1, 2]) AS u),
log AS (SELECT u, t, p, d, max(run) AS last, min(run) AS first, arg_min(disc, run) AS disc FROM r JOIN upto ON run <= u GROUP BY u, t, p, d),
pubs AS (SELECT log.u, log.t, log.p, log.d, log.first, log.disc, r.title, r.codes FROM log JOIN r ON r.t = log.t AND r.p = log.p AND r.run = log.last),
facts AS (SELECT u, t, arg_max(title, (d, p)) FILTER (title IS NOT NULL) AS title, arg_max(codes, (d, p)) FILTER (len(codes) > 0) AS codes, arg_max(p, (d, p)) AS p, arg_max(d, (d, p)) AS d,
    arg_min(disc, (first, d, p)) AS disc, string_agg(CAST(p AS VARCHAR), ',' ORDER BY d, p) AS ps, count(*) FILTER (first = 2) AS added FROM pubs GROUP BY u, t)
SELECT n.t AS tender, n.title, array_to_string(n.codes, ',') AS codes, CAST(n.p AS VARCHAR) AS publication_id, n.d AS published, n.disc AS discovery, n.ps AS publications,
  CASE WHEN o.t IS NULL THEN 'new' WHEN (n.title, n.codes, n.p, n.d, n.ps) IS NOT DISTINCT FROM (o.title, o.codes, o.p, o.d, o.ps) THEN 'unchanged' ELSE 'updated' END AS status, n.added
FROM (SELECT * FROM facts WHERE u = 2) n LEFT JOIN (SELECT * FROM facts WHERE u = 1) o ON o.t = n.t""",
}
