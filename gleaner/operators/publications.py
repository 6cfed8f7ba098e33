"""Tenders as a log of publications: runs are appended, facts are merged on reading, and the log is compacted.

Each run commits its publications as a run of the store, so it is seen whole or not at
all. Facts take every publication once, as the newest run that saw it says, and every
field from the latest publication that has it. Compaction writes one row a publication to
a base that stands for all runs up to its number; readers change over to it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import publication_order
from .store import committed, committed_runs, write_run

TABLE, BASE = "publications", "base-"
#: What a publication row says of its log: the run that saw it last and first, and where its tender was first found.
OWN = ["tender", "publication_id", "seen", "first_seen", "discovery"]


def append(rows: DataFrame, folder: str, run: int) -> None:
    """Commit the publications of a run: tender, publication_id, published, discovery and any facts. ``run`` counts up."""
    stamped = rows.withColumns({"seen": F.lit(run).cast("long"), "first_seen": F.lit(run).cast("long")})
    write_run({TABLE: once_each(stamped)}, folder, str(run))


def once_each(rows: DataFrame) -> DataFrame:
    """One row a publication: facts of the run that saw it last, first run and place of discovery of the one that saw it first."""
    facts = [c for c in rows.columns if c not in OWN]
    newest = F.struct("seen", F.xxhash64(*facts))  # of two rows of one run any, but always the same
    return rows.groupBy("tender", "publication_id").agg(
        F.max_by(F.struct(*facts), newest).alias("facts"), F.max("seen").alias("seen"), F.min("first_seen").alias("first_seen"), F.min_by("discovery", F.struct("first_seen", "discovery")).alias("discovery")
    ).select(*OWN, *(F.col("facts")[c].alias(c) for c in facts))


def _base(spark: SparkSession, folder: str) -> int:
    """The run up to which a base stands for all; 0 without one."""
    names = committed_runs(spark, folder)
    found = names.where(F.startswith("run", F.lit(BASE))).agg(F.max(F.substring("run", len(BASE) + 1, 20).cast("long"))).first()
    return found[0] or 0


def publications(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """All publications of the log, or of its runs up to a number that no base covers, one row each."""
    base = _base(spark, folder)
    number = F.col("run").try_cast("long")
    live = (F.col("run") == f"{BASE}{base}") | (number > base)
    if upto is not None:
        if upto < base:
            raise ValueError(f"runs up to {base} are compacted")
        live = live & (number.isNull() | (number <= upto))
    return once_each(committed(spark, folder, TABLE).where(live).drop("run"))


def compact(spark: SparkSession, folder: str, upto: int) -> None:
    """Write the base that stands for the runs up to ``upto``; what is read stays the same."""
    write_run({TABLE: publications(spark, folder, upto)}, folder, f"{BASE}{upto}")


def facts(log: DataFrame, fields: list[str]) -> DataFrame:
    """One row a tender: each field from the latest publication that has it (lists: that is not empty), the latest
    publication's number and date, where the tender was found first, and all its publications, oldest first."""
    kinds = dict(log.dtypes)
    order = publication_order(F.col("published"), F.col("publication_id"))
    has: dict[str, Column] = {f: F.size(f) > 0 if kinds[f].startswith("array") else F.col(f).isNotNull() for f in fields}
    return log.groupBy("tender").agg(
        *(F.max_by(f, F.when(has[f], order)).alias(f) for f in fields),
        F.max_by("publication_id", order).alias("publication_id"),
        F.max_by("published", order).alias("published"),
        F.min_by("discovery", F.struct("first_seen", order)).alias("discovery"),
        F.max("first_seen").alias("last_new"),
        # the list is what was asked for: as long as the tender has publications
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("at"), "publication_id"))), lambda x: x["publication_id"]).alias("publications"),
    )


def update(before: DataFrame, after: DataFrame, fields: list[str], run: int) -> DataFrame:
    """Facts after a run with ``status`` (new, updated, unchanged) and how many publications the run added.

    ``before`` and ``after`` are publications of the log up to the run before and up to this one. Where a tender was
    first found is no news.
    """
    compared = [*fields, "publication_id", "published", "publications"]
    old = facts(before, fields).select(F.col("tender").alias("had"), F.struct(*compared).alias("was"))
    added = after.where(F.col("first_seen") == run).groupBy(F.col("tender").alias("of")).agg(F.count(F.lit(1)).alias("added"))
    now = facts(after, fields)
    met = now.join(old, now["tender"] == old["had"], "left").join(added, now["tender"] == added["of"], "left")
    same = F.struct(*compared).eqNullSafe(F.col("was"))
    status = F.when(F.col("had").isNull(), F.lit("new")).when(same, F.lit("unchanged")).otherwise(F.lit("updated"))
    return met.select(*now.columns, status.alias("status"), F.coalesce("added", F.lit(0)).alias("added"))
