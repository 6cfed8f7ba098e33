"""Statistics and decisions of runs, each one grouped aggregation; and the steps between candidates and pages."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Candidate scores from which confidence is high or medium.
HIGH, MEDIUM = 60, 20


def crawl_statistics(requests: DataFrame, by: str) -> DataFrame:
    """One row for each crawl of rows (url, identity, status, attempted, score, known, unchanged).

    Things to crawl are counted by identity where one is known, else by URL.
    """
    n = lambda c: F.count_if(c)
    attempted, status, score = F.col("attempted"), F.col("status"), F.col("score")
    things = F.countDistinct(F.coalesce("identity", "url"))
    return requests.groupBy(by).agg(
        F.countDistinct("url").alias("requests_queued"),
        n(attempted).alias("requests_started"),
        n(attempted & status.isin("ok", "redirect")).alias("requests_succeeded"),
        n(attempted & status.isin("failed", "http_error")).alias("requests_failed"),
        F.count(F.lit(1)).alias("candidates"),
        things.alias("identities"),
        (F.count(F.lit(1)) - things).alias("identity_duplicates"),
        n(score >= HIGH).alias("high_confidence"),
        n((score >= MEDIUM) & (score < HIGH)).alias("medium_confidence"),
        n(score < MEDIUM).alias("low_confidence"),
        n(F.col("known")).alias("known"),
        n(~F.col("known")).alias("new"),
        n(F.col("unchanged")).alias("unchanged"),
        n(~attempted).alias("remaining"),
    )


def crawler_health(phase: Column, status: Column, pages: Column) -> Column:
    """partial if the engine failed after some pages, failed if not one page came; null where the crawl's own status stands."""
    return F.when(phase.isNotNull() & (pages > 0), F.lit("partial")).when(
        phase.isNotNull() | ((status == "failed") & (pages == 0)), F.lit("failed")
    )


def assessment_outcome(kind: Column, rejection: Column, location: Column, codes: Column, prefixes: list[str]) -> Column:
    """accepted, or why a page is none of the tenders sought: its own rejection, its country, its codes."""
    fits = reduce(lambda a, p: a | F.exists(codes, lambda c: F.startswith(c, F.lit(p))), prefixes, F.lit(False))
    return (
        F.when(kind != "detail", F.coalesce(rejection, F.lit("not_a_tender")))
        .when(location == "foreign", F.lit("foreign_country"))
        .when(F.lit(bool(prefixes)) & (F.size(codes) > 0) & ~fits, F.lit("cpv_mismatch"))
        .otherwise(F.lit("accepted"))
    )


def tally(assessments: DataFrame, by: str, prefixes: list[str]) -> DataFrame:
    """Counters of assessed pages (kind, outcome, codes) by source, with the reasons and their numbers as a map."""
    n = lambda c: F.count_if(c)
    kind, outcome = F.col("kind"), F.col("outcome")
    reasons = (
        assessments.where(outcome != "accepted").groupBy(by, "outcome").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col(by).alias("reason_of")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("reasons"))
    )
    counted = assessments.groupBy(by).agg(
        F.count(F.lit(1)).alias("assessed"),
        n(kind == "overview").alias("overview"),
        n(kind == "general").alias("general"),
        n(outcome != "accepted").alias("rejected"),
        n(outcome == "cpv_mismatch").alias("filtered_by_cpv"),
        n((outcome == "accepted") & F.lit(bool(prefixes)) & (F.size("codes") == 0)).alias("cpv_unknown"),
        n(outcome == "accepted").alias("accepted"),
    )
    return counted.join(reasons, F.col(by) == F.col("reason_of"), "left").drop("reason_of")


def tender_run_statistics(tenders: DataFrame, by: str, categories: list[str]) -> DataFrame:
    """Per run of rows (system, status, location, codes): official and web results, open and relevant ones, what the run yields."""
    fits = reduce(lambda a, p: a | F.exists("codes", lambda c: F.startswith(c, F.lit(p))), categories, F.lit(not categories))
    web, is_open = F.col("system") == "website", F.col("status") == "open"
    relevant = F.count_if(is_open & (~web | ((F.col("location") == "confirmed") & fits)))
    return tenders.groupBy(by).agg(
        F.count(F.lit(1)).alias("tenders"),
        F.count_if(~web).alias("official"),
        F.count_if(web).alias("web"),
        F.count_if(is_open).alias("open"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
        relevant.alias("open_relevant"),
        F.when(relevant > 0, F.lit("open_matches")).otherwise(F.lit("no_confirmed_open_matches")).alias("yield"),
    )


def coverage_complete(groups: DataFrame, by: str) -> DataFrame:
    """True where every source of a run was exhausted without a time limit, a failed detail or a failure."""
    good = F.col("exhausted") & (F.col("stop_reason") != "time_limit") & (F.col("detail_failures") == 0) & (F.col("status") != "failed")
    return groups.groupBy(by).agg(F.bool_and(good).alias("coverage_complete"))


def company_run_statistics(companies: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """Per run: companies by status, and why its picture is incomplete, in a fixed order."""
    counted = companies.groupBy(by).agg(
        F.count(F.lit(1)).alias("companies"), *(F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "possible", "insufficient"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whys = [
        (zero("sites_failed") > 0, F.concat(zero("sites_failed").cast("string"), F.lit(" website(s) konden niet worden gelezen"))),
        (zero("sites_incomplete") > 0, F.concat(zero("sites_incomplete").cast("string"), F.lit(" website(s) niet volledig doorlopen"))),
        (zero("not_researched") > 0, F.concat(zero("not_researched").cast("string"), F.lit(" kandidaat-bedrijven wachten op een vervolgbatch"))),
        (F.coalesce("time_limit", F.lit(False)), F.lit("tijdslimiet bereikt")),
        (zero("query_errors") > 0, F.concat(zero("query_errors").cast("string"), F.lit(" zoekopdracht(en) mislukt"))),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, text) for c, text in whys)))
    found = sources.join(counted, by, "left").fillna(0, ["companies", "confirmed", "possible", "insufficient"])
    outcome = F.when(F.col("companies") == 0, F.lit("no_matches")).when(F.col("confirmed") > 0, F.lit("confirmed_matches")).otherwise(F.lit("possible_matches_only"))
    return found.select(by, "companies", "confirmed", "possible", "insufficient", reasons.alias("incomplete_reasons"), (F.size(reasons) == 0).alias("coverage_complete"), outcome.alias("yield"))


def claim_continuations(runs: DataFrame, continues: str, order: list[str]) -> DataFrame:
    """Follow-up runs with ``claims``: of those that continue one run and have not failed, the earliest."""
    first = F.row_number().over(Window.partitionBy(continues, F.col("status") == "failed").orderBy(*order)) == 1
    return runs.where(F.col(continues).isNotNull()).withColumn("claims", (F.col("status") != "failed") & first)


def within_budget(rows: DataFrame, by: str, order: str, needs: Column, budget: int) -> DataFrame:
    """Adds ``granted``: the first ``budget`` rows of each group, in order, that need it."""
    wanted = F.coalesce(needs, F.lit(False))
    so_far = F.sum(wanted.cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("granted", wanted & (so_far <= budget))


def candidates_by_domain(results: DataFrame, domain: str, order: str) -> DataFrame:
    """One candidate for each domain of rows (url, title, hits): results, the most hits, and what the first one says.

    ``place``: most hits first, then most results, then the earliest.
    """
    at = lambda c: F.min_by(c, order)
    found = results.groupBy(domain).agg(
        F.count(F.lit(1)).alias("results"), F.max("hits").alias("hits"), at("url").alias("url"), at("title").alias("title"), F.min(order).alias("first")
    )
    return found.withColumn("sort", F.struct(-F.col("hits"), -F.col("results"), F.col("first")))


def without_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not known: what is left to visit, or what is new."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def match_any_key(incoming: DataFrame, stored: DataFrame, keys: list[tuple[str, int]], possible: int, duplicate: int) -> DataFrame:
    """Incoming rows with the stored one that they match best, by any of several keys.

    Both tables have a unique ``ord`` and the key columns. A pair's points are those of all keys it shares, summed
    and at most 100. ``match``: the earliest stored row that reaches ``duplicate``; ``possible``: any reaches ``possible``.

    No pairs are formed: of every set of keys whose points reach ``possible``, the earliest stored row with each
    combination of values is known, and an incoming row meets that one. The pair that shares most is among those of
    its own set, and the earliest good one among those of a set that reaches ``duplicate``, so nothing is lost.
    """
    names = [k for k, _ in keys]
    sets = [s for n in range(1, len(keys) + 1) for s in combinations(keys, n)]
    reaching = [([k for k, _ in s], min(100, sum(p for _, p in s))) for s in sets if sum(p for _, p in s) >= possible]
    known = lambda members: reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in members))
    cell = lambda n, members, points: F.when(known(members), F.struct(F.lit(n).alias("set"), F.lit(points).alias("points"), F.array(*(F.col(k).cast("string") for k in members)).alias("values")))
    cells = F.inline(F.array_compact(F.array(*(cell(n, *s) for n, s in enumerate(reaching)))))
    left = incoming.groupBy(*names).agg(F.min("ord").alias("a"))
    right = stored.groupBy(*names).agg(F.min("ord").alias("b"))
    firsts = right.select("b", cells).groupBy("set", "values").agg(F.min("b").alias("b"))
    met = left.select("a", cells).join(firsts, ["set", "values"])
    best = met.groupBy("a").agg(F.max("points").alias("score"), F.min(F.when(F.col("points") >= duplicate, F.col("b"))).alias("match"))
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in names]
    classes = left.join(best, "a").select(*names, "score", "match")
    return incoming.alias("i").join(classes.alias("c"), same, "left").select("i.*", "score", "match", F.col("score").isNotNull().alias("possible"))
