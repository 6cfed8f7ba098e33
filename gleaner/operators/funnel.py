"""Reports of a run: exclusive buckets by provider and in total, source outcomes, crawl statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = [
    "discovered", "not_processed", "no_usable_data", "rejected_by_relevance", "relevant", "rejected_by_date",
    "duplicates_in_run", "already_known", "cut_by_target", "new_records", "multi_record_extra",
]


def run_breakdown(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Buckets of each provider and, with provider null, of the run.

    ``sites``: site, discovered, attempted, with_data; ``facts``: site, relevant, outcome, stored. A fact
    without site counts for ``unknown``. Every candidate ends in one bucket: discovered plus
    multi_record_extra is the sum of the exclusive ones.
    """
    outcome, relevant = F.col("outcome"), F.col("relevant")
    settled = relevant & ~F.coalesce(outcome.isin("date_rejected", "duplicate_in_run", "already_known"), F.lit(False))
    counts = facts.groupBy(F.coalesce("site", F.lit("unknown")).alias("site")).agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(~relevant).alias("rejected_by_relevance"),
        F.count_if(relevant).alias("relevant"),
        F.count_if(relevant & (outcome == "date_rejected")).alias("rejected_by_date"),
        F.count_if(relevant & (outcome == "duplicate_in_run")).alias("duplicates_in_run"),
        F.count_if(relevant & (outcome == "already_known")).alias("already_known"),
        F.count_if(settled & ~F.col("stored")).alias("cut_by_target"),
        F.count_if(settled & F.col("stored")).alias("new_records"),
    )
    zero = F.lit(0)
    each = sites.join(counts, "site", "full_outer").select(
        "site",
        F.coalesce("discovered", zero).alias("discovered"),
        F.greatest(zero, F.coalesce(F.col("discovered") - F.col("attempted"), zero)).alias("not_processed"),
        F.greatest(zero, F.coalesce(F.col("attempted") - F.col("with_data"), zero)).alias("no_usable_data"),
        *(F.coalesce(c, zero).alias(c) for c in BUCKETS[3:10]),
        F.greatest(zero, F.coalesce("facts", zero) - F.coalesce("with_data", zero)).alias("multi_record_extra"),
    )
    return each.rollup("site").agg(*(F.sum(b).cast("bigint").alias(b) for b in BUCKETS)).withColumnRenamed("site", "provider")


def source_status(rows: DataFrame, source: str, failed: Column, returned: Column) -> DataFrame:
    """complete, partial or failed for each source, by its failed and returned requests."""
    return rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(failed).alias("failures"),
        F.sum(returned).cast("bigint").alias("returned"),
        F.when(F.count_if(~failed) == 0, F.lit("failed")).when(F.count_if(failed) > 0, F.lit("partial")).otherwise(F.lit("complete")).alias("status"),
    )


def crawl_status(blocked: Column, live_pages: Column, page_limit: Column, candidate_limit: Column, waiting: Column) -> Column:
    """Why a crawl ended: blocked before page limit before candidate limit before exhaustion."""
    return (
        F.when(blocked, F.lit("blocked"))
        .when(live_pages >= page_limit, F.lit("page_limit"))
        .when((candidate_limit > 0) & (waiting >= candidate_limit), F.lit("candidate_limit"))
        .otherwise(F.lit("exhausted"))
    )


def histogram(rows: DataFrame, value: Column) -> DataFrame:
    """Number of rows by value, nulls left out."""
    return rows.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
