"""The record store, relevance, dates, filters and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions import dates
from gleaner.functions.text import dedupe_key, tokens_of
from gleaner.operators import matching, store
from gleaner.operators.components import connected_components
from gleaner.operators.relevance import Query, keyword_hits, with_relevance

from .tables import FACTS_SQL, document_facts, table

NOW = "1997-07-01 06:00:00"


def add_missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the second half of lineitem that the first half doesn't have, by null-safe keys."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("source"), "l_linenumber")
    new = store.insert_missing(l.where("l_linenumber <= 3"), l.where("l_linenumber > 3").select("l_partkey", "source"), ["l_partkey", "source"])
    return new.select("l_partkey", "source")


def observe_in_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are records of their customer's project, each with a run; finished orders were observed before."""
    o = table(spark, sf_dir, "orders")
    records = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("snapshot"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") + 1000000).alias("run_id"))
    observed = o.where("o_orderstatus = 'F'").select((F.col("o_custkey") + 1000000).alias("run_id"), F.col("o_orderkey").alias("record_id"))
    return store.observe(records, runs, observed)


def run_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of a run with the live status beside them, for customers of one segment."""
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    l = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("snapshot"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, "o_orderkey").select("o_orderkey", "c_name", "snapshot", F.col("o_orderstatus").alias("live"))


def module_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as workspaces, segments as modules, regions as packages."""
    n = table(spark, sf_dir, "nation")
    workspaces = n.select(F.col("n_nationkey").alias("workspace"), F.col("n_regionkey").alias("package"))
    c = table(spark, sf_dir, "customer")
    modules = c.select(F.col("c_mktsegment").alias("module")).distinct().withColumn("enabled", F.col("module") != "FURNITURE")
    packages = n.select(F.col("n_regionkey").alias("package")).distinct().crossJoin(modules.select("module")).where("(package + length(module)) % 2 = 0")
    choices = workspaces.crossJoin(modules.select("module")).where("(workspace + length(module)) % 4 = 0").select("workspace", "module", (F.col("workspace") % 2 == 0).alias("choice"))
    return store.module_access(workspaces, modules, packages, choices)


def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that delivered with every return flag and in all seven lines."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("item"))
    return store.holds_all(l, "l_suppkey", "item", l.select("item").distinct())


def package_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct types of a brand's large parts, sorted and joined; empty for a brand without any."""
    p = table(spark, sf_dir, "part")
    large = F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type"))))
    return p.groupBy("p_brand").agg(F.array_join(large, ",").alias("types"), F.count(F.lit(1)).alias("parts"))


def soft_delete_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not deleted (every 13th is), with customer."""
    o = table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderdate")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kept = store.active(o).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return kept.select("o_orderkey", "c_name", "o_orderdate")


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of two systems: orders, and lines that state an order's number; a bad number links nothing."""
    o = table(spark, sf_dir, "orders")
    ted = o.where("o_orderstatus = 'F'").select((F.col("o_orderkey") * 10).alias("ord"), F.col("o_orderkey").cast("string").alias("number"), F.lit("ted").alias("system"), F.col("o_orderpriority").alias("title"))
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    l = l.agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    dutch = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_orderkey").cast("string")).otherwise(F.lit("n/a")).alias("number"),
        F.lit("tenderned").alias("system"),
        F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).alias("title"),
    )
    records = ted.unionByName(dutch)
    edges = dutch.alias("d").join(ted.alias("t"), (F.col("d.number") == F.col("t.number")) & F.rlike("d.number", F.lit("^[0-9]{1,8}$")))
    return records, edges.select(F.col("d.ord").alias("a"), F.col("t.ord").alias("b"))


def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, edges = _linked(spark, sf_dir)
    groups = connected_components(edges, "a", "b")
    joined = records.join(groups, F.col("ord") == F.col("node"), "left").withColumn("root", F.coalesce("component", "ord"))
    return joined.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max("ord").alias("last_member"))


def combine_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of each group: that of the national record if it states one, else the other system's, named."""
    records, edges = _linked(spark, sf_dir)
    groups = connected_components(edges, "a", "b")
    joined = records.join(groups, F.col("ord") == F.col("node"), "left").withColumn("root", F.coalesce("component", "ord"))
    place = F.when(F.col("title").isNotNull(), F.struct((F.col("system") == "ted").cast("int"), "ord"))
    return joined.groupBy("root").agg(F.min_by("title", place).alias("title"), F.min_by("system", place).alias("title_system"))


_LINKED_SQL = """
WITH ted AS (SELECT o_orderkey * 10 AS ord, CAST(o_orderkey AS VARCHAR) AS number, 'ted' AS system, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F'),
 dutch AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_orderkey AS VARCHAR) ELSE 'n/a' END AS number, 'tenderned' AS system,
   CASE WHEN l_quantity > 25 THEN l_returnflag END AS title
   FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
 j AS (SELECT d.ord, d.title, d.system, coalesce(t.ord, d.ord) AS root FROM dutch d LEFT JOIN ted t ON d.number = t.number
   UNION ALL SELECT ord, title, system, ord FROM ted)
"""


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a fixed request."""
    q = Query.parse("thation", "onthe reation, erther", "fr")
    f = document_facts(spark, sf_dir)
    r = with_relevance(f, "title", "description", "company", F.lit(None).cast("string"), F.col("location"), q)
    return r.select(
        F.col("ord").alias("doc_id"), "relevance.accepted", "relevance.reason", "relevance.score",
        F.array_join("relevance.matched_terms", ",").alias("matched_terms"), "relevance.location_match",
    )


def keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least one of three terms, and how many."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", keyword_hits(F.col("text"), ["ation", "ender", "worth"]).cast("int").alias("hits")).where("hits > 0")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of significant and of different significant words of each title."""
    f = document_facts(spark, sf_dir)
    t = tokens_of(F.col("title"))
    return f.select(F.col("ord").alias("doc_id"), F.size(t).alias("words"), F.size(F.array_distinct(t)).alias("different"), dedupe_key(F.col("title")).alias("title_key"))


def publication_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's active days as blocks of seven, newest first."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    return e.select("user_id", F.posexplode(dates.publication_blocks(F.col("first"), F.col("last"))).alias("block", "b")).select("user_id", "block", "b.block_from", "b.block_to")


def prefix_category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type starts with a wanted word; parts of size 1 have no type and stay, marked."""
    p = table(spark, sf_dir, "part").withColumn("codes", F.when(F.col("p_size") > 1, F.split("p_type", " ")))
    fits = F.exists("codes", lambda c: F.startswith(c, F.lit("PROMO")) | F.startswith(c, F.lit("ECON")))
    return p.select("p_partkey", F.col("codes").isNull().alias("unknown"), F.coalesce(fits, F.lit(True)).alias("fits")).where("fits").select("p_partkey", "unknown")


def names_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names match another part's of the same brand and size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), "p_brand", "p_size", matching.name_tokens(F.lower("p_name")).alias("tokens"))
    return matching.similar_names(p, ["p_brand", "p_size"])


def activity_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of licenses as activities of a source: strong if a title names one or two documents do."""
    d = table(spark, sf_dir, "documents")
    terms = F.explode(F.array(F.lit("license"), F.lit("public"), F.lit("worthless")))
    low = F.lower("text")
    hits = d.select("source", "doc_id", low.alias("low"), terms.alias("activity")).withColumn("mentions", F.regexp_count("low", F.col("activity")))
    named = F.contains(F.substring_index("low", "\n", 1), F.col("activity"))
    found = hits.where("mentions > 0").select("source", "activity", F.col("doc_id").alias("page"), F.when(named, F.lit("title")).otherwise(F.lit("text")).alias("place"), "mentions")
    return matching.activity_strength(found, ["source", "activity"])


def criteria_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each order from its lines: kinds are the ship years, confirmed by quantity."""
    l = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_quantity") >= 30, F.lit("confirmed")).when(F.col("l_quantity") >= 12, F.lit("possible")).otherwise(F.lit("insufficient"))
    kind = F.when(F.col("l_linenumber") <= 2, F.lit("activity")).when(F.col("l_linenumber") <= 4, F.lit("sector")).otherwise(F.lit("place"))
    return matching.criteria_status(l.select("l_orderkey", kind.alias("kind"), status.alias("status")), "l_orderkey", ["activity", "sector"])


def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that fit all of four facets."""
    p = table(spark, sf_dir, "part")
    wanted = p.where("p_size between 10 and 30").where(F.startswith("p_type", F.lit("STANDARD"))).where(F.col("p_retailprice") < 1500)
    return wanted.where(~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey", "p_brand")


def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of two facets, with how often each stands."""
    p = table(spark, sf_dir, "part")
    each = p.select(F.explode(F.array(F.struct(F.lit("brand").alias("facet"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("facet"), F.col("p_size").cast("string").alias("value")))).alias("f"))
    return each.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("parts"))


def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than two requests in a window of fifteen minutes."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests")).where("requests > 2").select("user_id", F.col("w.start").alias("window_start"), "requests")


def opportunity_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's deadline, 40 days on, has passed; every ninth has none."""
    o = table(spark, sf_dir, "orders")
    deadline = F.when(F.col("o_orderkey") % 9 != 0, F.date_format(F.date_add("o_orderdate", 40), "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", dates.opportunity_status(deadline, F.lit(NOW).cast("timestamp")).alias("status"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number in the properties of each event, null where it is none, by type."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("known"), F.sum("k").cast("bigint").alias("total"), F.max("k").alias("most"))


#: Documents of a source are compared in ranges of doc_id of this width, so that no window grows with a source.
RANGE = 10_000


def content_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content hash differs from that of the document before with the same source.

    The first of a range looks at the last of the range before: one row a source and range.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"), F.floor(F.col("doc_id") / RANGE).alias("span"))
    ends = d.groupBy("source", "span").agg(F.max_by("hash", "doc_id").alias("end"))
    borders = ends.select("source", "span", F.lag("end").over(Window.partitionBy("source").orderBy("span")).alias("border"))
    w = Window.partitionBy("source", "span").orderBy("doc_id")
    placed = d.withColumns({"n": F.row_number().over(w), "own": F.lag("hash").over(w)}).join(borders, ["source", "span"])
    before = F.when(F.col("n") == 1, F.col("border")).otherwise(F.col("own"))
    state = F.when(before.isNull(), F.lit("new")).when(before == F.col("hash"), F.lit("unchanged")).otherwise(F.lit("changed"))
    return placed.withColumn("state", state).groupBy("source", "state").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "add_missing_sources": add_missing_sources,
    "observe_in_run": observe_in_run,
    "run_snapshots": run_snapshots,
    "module_access": module_access,
    "relational_division": relational_division,
    "package_modules": package_modules,
    "soft_delete_listing": soft_delete_listing,
    "linked_groups": linked_groups,
    "combine_linked": combine_linked,
    "relevance_gate": relevance_gate,
    "keyword_match": keyword_match,
    "token_counts": token_counts,
    "publication_blocks": publication_blocks,
    "prefix_category_filter": prefix_category_filter,
    "names_match": names_match,
    "activity_strength": activity_strength,
    "criteria_match_status": criteria_match_status,
    "facet_filter": facet_filter,
    "facet_options": facet_options,
    "rate_limit_windows": rate_limit_windows,
    "opportunity_status": opportunity_status,
    "props_json": props_json,
    "content_change": content_change,
}

_STOP = "('en', 'of', 'de', 'het', 'een', 'in', 'op', 'voor', 'van', 'the', 'and', 'or', 'for', 'to', 'at')"
ORACLES = {
    "add_missing_sources": """WITH l AS (SELECT l_partkey, CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS source, l_linenumber FROM lineitem)
      SELECT DISTINCT l_partkey, source FROM l a WHERE l_linenumber > 3 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.l_linenumber <= 3 AND b.l_partkey = a.l_partkey AND b.source IS NOT DISTINCT FROM a.source)""",
    "observe_in_run": """SELECT o_custkey + 1000000 AS run_id, o_orderkey AS record_id, o_orderstatus AS snapshot FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'""",
    "run_snapshots": """SELECT o_orderkey, c_name, l_linestatus AS snapshot, o_orderstatus AS live FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      WHERE c_mktsegment = 'BUILDING' AND l_linenumber = 1""",
    "module_access": """WITH m AS (SELECT DISTINCT c_mktsegment AS module FROM customer),
      x AS (SELECT n_nationkey AS workspace, module, (n_regionkey + length(module)) % 2 = 0 AS by_package, CASE WHEN (n_nationkey + length(module)) % 4 = 0 THEN n_nationkey % 2 = 0 END AS choice FROM nation CROSS JOIN m)
      SELECT *, module <> 'FURNITURE' AND coalesce(choice, by_package) AS allowed FROM x""",
    "relational_division": """WITH i AS (SELECT DISTINCT l_suppkey, l_returnflag || CAST(l_linenumber AS VARCHAR) AS item FROM lineitem)
      SELECT l_suppkey FROM i GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT item) FROM i)""",
    "package_modules": "SELECT p_brand, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (p_size > 40), '') AS types, count(*) AS parts FROM part GROUP BY 1",
    "soft_delete_listing": """SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 13 <> 0""",
    "combine_linked": _LINKED_SQL
    + """SELECT min(ord) AS root, coalesce(arg_min(title, ord) FILTER (title IS NOT NULL AND system = 'tenderned'), arg_min(title, ord) FILTER (title IS NOT NULL)) AS title,
      coalesce(arg_min(system, ord) FILTER (title IS NOT NULL AND system = 'tenderned'), arg_min(system, ord) FILTER (title IS NOT NULL)) AS title_system FROM j GROUP BY j.root""",
    "relevance_gate": "WITH "
    + FACTS_SQL
    + r""", w AS (SELECT ord, location, string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS t,
        string_split(trim(regexp_replace(lower(coalesce(description, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS d FROM facts),
      c AS (SELECT *, ['thation', 'onthe', 'reation', 'erther'] AS terms, len(list_filter(d, lambda w: starts_with(w, 'thation') OR starts_with(w, 'onthe') OR starts_with(w, 'reation') OR starts_with(w, 'erther')))
          + len(list_filter(range(1, len(d)), lambda i: d[i] = 'onthe' AND d[i + 1] = 'reation')) AS mentions,
        len(list_filter(range(1, len(t)), lambda i: t[i] = 'onthe' AND t[i + 1] = 'reation')) > 0 AS tp FROM w),
      m AS (SELECT *, list_filter(terms, lambda x: len(list_filter(t, lambda w: starts_with(w, x))) > 0) AS tm, list_filter(terms, lambda x: len(list_filter(d, lambda w: starts_with(w, x))) > 0) AS dm,
        tp OR len(list_filter(range(1, len(d)), lambda i: d[i] = 'onthe' AND d[i + 1] = 'reation')) > 0 AS ph FROM c),
      r AS (SELECT *, list_concat(tm, list_filter(dm, lambda x: NOT list_contains(tm, x))) AS matched, CASE WHEN list_contains(tm, 'thation') THEN 'title_branch_match' WHEN tp THEN 'keyword_phrase_match' WHEN len(tm) > 0 THEN 'keyword_title_match'
        WHEN mentions >= 2 AND mentions / greatest(1, CASE WHEN d = [''] THEN 0 ELSE len(d) END) >= 0.007 THEN 'description_content_match' WHEN len(dm) = 0 THEN 'rejected_no_match' ELSE 'rejected_weak_evidence' END AS reason FROM m)
      SELECT ord AS doc_id, NOT starts_with(reason, 'rejected') AS accepted, reason, CAST(len(tm) * 3 + len(dm) + CASE WHEN ph THEN 4 ELSE 0 END
        + CASE WHEN NOT starts_with(reason, 'rejected') AND coalesce(location = 'fr', false) THEN 1 ELSE 0 END AS INTEGER) AS score,
        array_to_string(matched, ',') AS matched_terms, CASE WHEN location IS NOT NULL THEN location = 'fr' END AS location_match FROM r""",
    "keyword_match": rf"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) >= 2 AND x NOT IN {_STOP}) AS w FROM documents),
      t AS (SELECT doc_id, unnest(w) AS w FROM w),
      m AS (SELECT doc_id, bool_or(w = 'ation' OR (length(w) >= 4 AND (starts_with(w, 'ation') OR starts_with('ation', w)))) AS a,
        bool_or(w = 'ender' OR (length(w) >= 4 AND (starts_with(w, 'ender') OR starts_with('ender', w)))) AS b,
        bool_or(w = 'worth' OR (length(w) >= 4 AND (starts_with(w, 'worth') OR starts_with('worth', w)))) AS c FROM t GROUP BY 1)
      SELECT doc_id, CAST(CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) AS INTEGER) AS hits FROM m WHERE a OR b OR c""",
    "token_counts": "WITH "
    + FACTS_SQL
    + rf""", w AS (SELECT ord, title, list_filter(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: length(x) >= 2 AND x NOT IN {_STOP}) AS w FROM facts)
      SELECT ord AS doc_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_distinct(w)) AS INTEGER) AS different, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS title_key FROM w""",
    "publication_blocks": """WITH e AS (SELECT user_id, min(CAST(ts AS DATE)) AS f, max(CAST(ts AS DATE)) AS l FROM events GROUP BY 1)
      SELECT user_id, CAST(i AS INTEGER) AS block, greatest(l - CAST(i * 7 + 6 AS INTEGER), f) AS block_from, l - CAST(i * 7 AS INTEGER) AS block_to FROM e, range(0, 10) r(i) WHERE l - CAST(i * 7 AS INTEGER) >= f""",
    "prefix_category_filter": """SELECT p_partkey, p_size <= 1 AS unknown FROM part WHERE p_size <= 1 OR len(list_filter(string_split(p_type, ' '), lambda c: starts_with(c, 'PROMO') OR starts_with(c, 'ECON'))) > 0""",
    "names_match": """WITH p AS (SELECT p_partkey, p_brand, p_size, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) >= 3
        AND x NOT IN ('het', 'een', 'van', 'der', 'den', 'the', 'and', 'gemeente', 'provincie', 'waterschap', 'stichting', 'ministerie', 'vereniging', 'www')) AS t FROM part),
      j AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN len(a.t) <= len(b.t) THEN a.t ELSE b.t END AS s, CASE WHEN len(a.t) <= len(b.t) THEN b.t ELSE a.t END AS l
        FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
      SELECT a, b FROM j WHERE len(s) > 0 AND len(list_filter(s, lambda w: list_contains(l, w))) / len(s) >= 0.6""",
    "activity_strength": """WITH t AS (SELECT source, doc_id, lower(text) AS low, unnest(['license', 'public', 'worthless']) AS activity FROM documents),
      h AS (SELECT *, (length(low) - length(replace(low, activity, ''))) // length(activity) AS mentions, contains(split_part(low, chr(10), 1), activity) AS named FROM t)
      SELECT source, activity, CAST(sum(mentions) AS BIGINT) AS mentions, count(DISTINCT doc_id) AS pages, CASE WHEN bool_or(named) OR count(DISTINCT doc_id) >= 2 THEN 'strong' ELSE 'weak' END AS strength
      FROM h WHERE mentions > 0 GROUP BY 1, 2""",
    "criteria_match_status": """WITH k AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'activity' WHEN l_linenumber <= 4 THEN 'sector' ELSE 'place' END AS kind,
        max(CASE WHEN l_quantity >= 30 THEN 2 WHEN l_quantity >= 12 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1, 2)
      SELECT l_orderkey, count(*) AS kinds, CASE WHEN min(r) = 2 THEN 'confirmed' WHEN coalesce(max(r) FILTER (kind <> 'place') = 0, false) THEN 'insufficient' WHEN max(r) > 0 THEN 'possible' ELSE 'insufficient' END AS status
      FROM k GROUP BY 1""",
    "facet_filter": "SELECT p_partkey, p_brand FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type LIKE 'STANDARD%' AND p_retailprice < 1500 AND p_brand NOT IN ('Brand#11', 'Brand#12')",
    "facet_options": "SELECT 'brand' AS facet, p_brand AS value, count(*) AS parts FROM part GROUP BY 2 UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY 2",
    "rate_limit_windows": "SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 2",
    "opportunity_status": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(CAST(o_orderdate AS DATE) + 40, '%Y-%m-%dT00:00:00') END AS d FROM orders)
      SELECT o_orderkey, CASE WHEN d IS NULL THEN 'unknown' WHEN d < '1997-07-01T08:00:00' THEN 'expired' ELSE 'open' END AS status FROM o""",
    "props_json": """WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
      SELECT event_type, count(k) AS known, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM e GROUP BY 1""",
    "content_change": """WITH d AS (SELECT source, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents)
      SELECT source, CASE WHEN b IS NULL THEN 'new' WHEN b = h THEN 'unchanged' ELSE 'changed' END AS state, count(*) AS documents FROM d GROUP BY 1, 2""",
}
ORACLES["linked_groups"] = _LINKED_SQL + "SELECT min(ord) AS root, count(*) AS members, max(ord) AS last_member FROM j GROUP BY j.root"
