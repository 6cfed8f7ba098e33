"""Statements of the record store over the test tables: nations are workspaces, regions their packages, priorities modules, customers users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import store
from gleaner.operators.storage import new_path

from .tables import table

NOW = "2024-01-20 00:00:00"
MODULES = ["companies", "tenders", "vacancies"]


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("workspace"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("package"))


def _modules(spark: SparkSession) -> DataFrame:
    names = F.array(*(F.struct(F.lit(m).alias("module"), F.lit(m != "companies").alias("enabled")) for m in MODULES))
    return spark.range(1).select(F.inline(names))


def _package_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("package"))
    return r.crossJoin(F.broadcast(_modules(spark).select("module"))).where((F.col("package") + F.length("module")) % 2 == 0)  # five packages, three modules


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspaces(spark, sf_dir).select("workspace").crossJoin(F.broadcast(_modules(spark).select("module")))  # 25 workspaces, three modules
    k = F.col("workspace") + F.length("module")
    return w.where(k % 3 == 0).select("workspace", "module", (k % 2 == 0).alias("choice"))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.module_access(_workspaces(spark, sf_dir).select("workspace", "package"), _modules(spark), _package_modules(spark, sf_dir), _choices(spark, sf_dir))


_ACCESS_SQL = """m AS (SELECT * FROM (VALUES ('companies', false), ('tenders', true), ('vacancies', true)) v(module, enabled)),
  w AS (SELECT n_nationkey AS workspace, n_name AS name, n_regionkey AS package FROM nation),
  c AS (SELECT workspace, module, (workspace + length(module)) % 2 = 0 AS choice FROM w, m WHERE (workspace + length(module)) % 3 = 0),
  a AS (SELECT workspace, name, package, module, enabled, (package + length(module)) % 2 = 0 AS by_package, choice FROM w CROSS JOIN m LEFT JOIN c USING (workspace, module))"""


def workspaces_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("workspace"))
    return users.join(_workspaces(spark, sf_dir), "workspace").select("user", "workspace", "name")


def access_list_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("package"), F.col("r_name").alias("package_name"))
    return _access(spark, sf_dir).join(_workspaces(spark, sf_dir), "workspace").join(packages, "package").select("name", "package_name", "module", "allowed")


def access_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose access the rule without packages (all but what is switched off) would have changed."""
    before = _access(spark, sf_dir).join(_modules(spark), "module").select("workspace", "module", (F.col("enabled") & F.coalesce("choice", F.lit(True))).alias("allowed"))
    return store.access_changes(before, _access(spark, sf_dir), ["workspace", "module"], "allowed")


def module_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.deviations(_access(spark, sf_dir)).select("workspace", "deviates", F.array_join("modules", ",").alias("modules"))


def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt are switched off, the others on: what the statement returns."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lit("new").alias("status"), F.lit(True).alias("enabled"))
    debt = F.col("s_acctbal") < 0
    _, changed = store.update_where(s, F.col("s_suppkey") % 2 == 0, {"enabled": ~debt, "status": F.when(debt, F.lit("disabled")).otherwise(F.lit("active"))})
    return changed.select("s_suppkey", "status", "enabled")


def delete_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _workspaces(spark, sf_dir).where("package = 1").select("workspace")
    return store.delete_where(_choices(spark, sf_dir), gone, ["workspace"])


def upsert_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _choices(spark, sf_dir).withColumn("updated_at", F.lit(0))
    put = _workspaces(spark, sf_dir).where("workspace % 2 = 0").select("workspace", F.lit("tenders").alias("module"), F.lit(False).alias("choice"), F.lit(1).alias("updated_at"))
    return store.upsert(old, put, ["workspace", "module"], F.lit(2))


def switch_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    switches = _workspaces(spark, sf_dir).where("workspace % 3 <> 2").select("workspace", (F.col("workspace") % 3 == 0).alias("custom"))
    return store.switch_package(_choices(spark, sf_dir), _access(spark, sf_dir), switches)


def optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    counted = lambda wanted: store.optional(c, "c_mktsegment", wanted).agg(F.count(F.lit(1)).alias("n")).select(F.lit(wanted or "any").alias("wanted"), "n")
    return counted(None).unionByName(counted("BUILDING"))


def access_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the workspace of user 7, as one user may see them."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("workspace"))
    o = table(spark, sf_dir, "orders").join(c.withColumnRenamed("user", "o_custkey"), "o_custkey")
    return store.visible_to(o, c, 7, "workspace").select("o_orderkey", "workspace")


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts").cast("timestamp") + F.expr("interval 7 days")).alias("expires"))
    return store.unexpired(e, "expires", F.lit(NOW).cast("timestamp")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots are added once for a run and a record: orders are runs, parts records; what the first lines bring stays."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("record"), "l_linenumber", "l_quantity")
    seen = lambda rows: rows.groupBy("run", "record").agg(F.min("l_quantity").alias("snapshot"))
    first, more = seen(l.where("l_linenumber = 1")), seen(l.where("l_linenumber > 1"))
    added = store.insert_missing(first, more, ["run", "record"])
    return first.unionByName(added).groupBy("run").agg(F.count(F.lit(1)).alias("records"), F.sum("snapshot").alias("total"))


def run_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and sources of two runs are written and committed; a third that fails before its marker is not seen."""
    folder = new_path(spark, "runs")
    o = table(spark, sf_dir, "orders")
    for run in (0, 1):
        part = o.where(F.col("o_orderkey") % 3 == run)
        store.write_run({"records": part.select("o_orderkey", "o_totalprice"), "sources": part.select("o_orderkey", "o_custkey")}, folder, f"r{run}")
    lost = o.where("o_orderkey % 3 = 2").select("o_orderkey", "o_totalprice", F.lit("r2").alias("run"), F.lit("a-lost").alias("attempt"))
    lost.write.parquet(f"{folder}/records/a-lost")
    records, sources = store.committed(spark, folder, "records"), store.committed(spark, folder, "sources")
    return records.join(sources.drop("run"), "o_orderkey").groupBy("run").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("o_custkey").alias("sources"))


def migrations_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.format_string("%03d_%s", "n_nationkey", F.lower("n_name")).alias("version"))
    return store.pending_migrations(files, files.where(F.substring("version", 1, 3).cast("int") % 4 != 1))


def public_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").drop("c_acctbal")


def ordered_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of suppliers by a score that may be unknown, in both directions."""
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 10).alias("score"), "s_nationkey")
    at = lambda *by: F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*by))
    return s.select("s_suppkey", at(store.sql_order("score"), "s_suppkey").alias("rising"), at(store.sql_order("score", True), "s_suppkey").alias("falling"))


def newest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(5).select("o_orderkey")


def records_this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    recent = F.col("ts").cast("timestamp") > F.lit(NOW).cast("timestamp") - F.expr("interval 7 days")
    return e.groupBy("event_type").agg(F.count_if(recent).alias("this_week"), F.count(F.lit(1)).alias("all"))


def dashboard_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and runs of all projects in one list, each with its project's name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("project_name"))
    o = table(spark, sf_dir, "orders")
    one = o.select(F.lit("record").alias("kind"), F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("id"))
    other = o.where("o_orderkey % 2 = 0").select(F.lit("run").alias("kind"), F.col("o_custkey").alias("project"), (-F.col("o_orderkey")).alias("id"))
    return one.unionByName(other).join(c, "project").groupBy("kind", "project_name").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        workspaces_of_users, access_list_names, access_changed, module_deviations, update_returning, delete_choices, upsert_choices, switch_package, optional_filter,
        access_semi_join, session_expiry, run_history, run_write, migrations_pending, public_users, ordered_with_nulls, newest_five, records_this_week, dashboard_fan_in,
    )
}

ORACLES = {
    "workspaces_of_users": "SELECT c_custkey AS \"user\", n_nationkey AS workspace, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "access_list_names": f"WITH {_ACCESS_SQL} SELECT name, r_name AS package_name, module, enabled AND coalesce(choice, by_package) AS allowed FROM a JOIN region ON package = r_regionkey",
    "access_changed": f"""WITH {_ACCESS_SQL}, d AS (SELECT workspace, module, enabled AND coalesce(choice, true) AS before, enabled AND coalesce(choice, by_package) AS after FROM a)
      SELECT * FROM d WHERE before IS DISTINCT FROM after""",
    "module_deviations": f"""WITH {_ACCESS_SQL} SELECT workspace, coalesce(bool_or(choice <> by_package), false) AS deviates,
      coalesce(string_agg(module, ',' ORDER BY module) FILTER (choice <> by_package), '') AS modules FROM a GROUP BY 1""",
    "update_returning": """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status, NOT s_acctbal < 0 AS enabled FROM supplier WHERE s_suppkey % 2 = 0""",
    "delete_choices": f"WITH {_ACCESS_SQL} SELECT * FROM c WHERE workspace NOT IN (SELECT workspace FROM w WHERE package = 1)",
    "upsert_choices": f"""WITH {_ACCESS_SQL} SELECT workspace, module, CASE WHEN put THEN false ELSE choice END AS choice, CAST(CASE WHEN put AND choice IS NOT NULL THEN 2 WHEN put THEN 1 ELSE 0 END AS INTEGER) AS updated_at
      FROM (SELECT *, workspace % 2 = 0 AND module = 'tenders' AS put FROM a) WHERE put OR choice IS NOT NULL""",
    "switch_package": f"""WITH {_ACCESS_SQL} SELECT workspace, module, coalesce(choice, by_package) AS choice FROM a WHERE workspace % 3 = 0
      UNION ALL SELECT workspace, module, choice FROM c WHERE workspace % 3 = 2""",
    "optional_filter": """SELECT 'any' AS wanted, count(*) AS n FROM customer UNION ALL SELECT 'BUILDING', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "access_semi_join": """SELECT o_orderkey, c_nationkey AS workspace FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7)""",
    "session_expiry": f"SELECT user_id, count(*) AS sessions FROM events WHERE CAST(ts AS TIMESTAMP) + INTERVAL 7 DAY > TIMESTAMP '{NOW}' GROUP BY 1",
    "run_history": """WITH f AS (SELECT l_orderkey AS run, l_partkey AS record, coalesce(min(l_quantity) FILTER (l_linenumber = 1), min(l_quantity)) AS snapshot FROM lineitem GROUP BY 1, 2)
      SELECT run, count(*) AS records, sum(snapshot) AS total FROM f GROUP BY 1""",
    "run_write": """SELECT 'r' || o_orderkey % 3 AS run, count(*) AS records, count(DISTINCT o_custkey) AS sources FROM orders WHERE o_orderkey % 3 < 2 GROUP BY 1""",
    "migrations_pending": """SELECT printf('%03d', n_nationkey) || '_' || lower(n_name) AS version, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS place FROM nation WHERE n_nationkey % 4 = 1""",
    "public_users": "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer",
    "ordered_with_nulls": """WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 10 END AS score FROM supplier)
      SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY score ASC NULLS LAST, s_suppkey) AS INTEGER) AS rising,
        CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC NULLS FIRST, s_suppkey) AS INTEGER) AS falling FROM s""",
    "newest_five": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5",
    "records_this_week": f"""SELECT event_type, count(*) FILTER (CAST(ts AS TIMESTAMP) > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS this_week, count(*) AS "all" FROM events GROUP BY 1""",
    "dashboard_fan_in": """WITH u AS (SELECT 'record' AS kind, o_custkey, o_orderkey AS id FROM orders UNION ALL SELECT 'run', o_custkey, -o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
      SELECT kind, c_name AS project_name, count(*) AS n, max(id) AS last FROM u JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
}
