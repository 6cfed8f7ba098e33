"""Versions of records: from what was seen when to intervals of validity, and what held at a moment.

A record with very many observations is no task of its own: its observations are
split by spans of time, what a span begins with is the last of the spans before, which
is known from one row for each span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Observations of a record within one such span of time are sorted together.
SPAN = "month"


def _spans(key: str) -> Window:
    return Window.partitionBy(key, "span").orderBy("at", "kind")


def _carried(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, at, kind, span, value) with ``held``: the last value of kind 0 at or before the row, over all spans.

    ``value`` is a struct that is never null where kind is 0.
    """
    within = F.last(F.when(F.col("kind") == 0, F.col("value")), ignorenulls=True).over(_spans(key).rowsBetween(Window.unboundedPreceding, 0))
    seen = rows.where("kind = 0").groupBy(F.col(key).alias("of"), F.col("span").alias("in")).agg(F.max_by("value", F.struct("at")).alias("latest"))
    every = rows.select(F.col(key).alias("of"), F.col("span").alias("in")).distinct().join(seen, ["of", "in"], "left")
    before = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)  # one row for each span of a record
    entering = every.withColumn("entering", F.last("latest", ignorenulls=True).over(before)).drop("latest")
    inner = rows.withColumn("inner", within)
    met = inner.join(entering, (F.col(key) == F.col("of")) & (F.col("span") == F.col("in")), "left")
    return met.withColumn("held", F.coalesce("inner", "entering")).drop("inner", "entering", "of", "in")


def as_of(questions: DataFrame, observed: DataFrame, key: str, moment: str, seen: str, columns: list[str]) -> DataFrame:
    """``questions`` with ``columns`` of the last observation of the same ``key`` at or before their ``moment``; null before the first.

    ``observed``: key, ``seen`` and the columns, one row for a key and moment. Questions without key or moment have nulls.
    Both tables are merged in order of time, in one shuffle by key and span of time, so no question meets more than
    one observation.
    """
    asked = questions.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(moment).cast("timestamp").alias("at"))
    known = observed.where(F.col(key).isNotNull() & F.col(seen).isNotNull()).select(
        F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.col(key).alias("key"), F.col(seen).cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.struct(*columns).alias("value")
    )
    nothing = F.lit(None).cast(known.schema["value"].dataType).alias("value")
    good = F.col("key").isNotNull() & F.col("at").isNotNull()
    merged = known.unionByName(asked.where(good).select("row", "key", "at", F.lit(1).alias("kind"), nothing)).withColumn("span", F.date_trunc(SPAN, "at"))
    answered = _carried(merged, "key").where("kind = 1").select("row", F.col("held").alias("value"))
    every = answered.unionByName(asked.where(~good).select("row", nothing))
    return every.select(*(F.col("row")[c].alias(c) for c in questions.columns), *(F.col("value")[c].alias(c) for c in columns))


def validity(observed: DataFrame, key: str, seen: str, columns: list[str]) -> DataFrame:
    """Intervals in which a record read the same: key, the columns, valid_from and valid_to (null: until now).

    ``observed`` has one row for a key and moment. An observation that repeats the one before begins no interval.
    """
    value = F.struct(*columns)
    rows = observed.where(F.col(key).isNotNull() & F.col(seen).isNotNull()).select(key, F.col(seen).alias("at"), F.lit(0).alias("kind"), F.date_trunc(SPAN, F.col(seen)).alias("span"), value.alias("value"))
    changed = _first_of_each(rows, key)
    following = F.lead("at").over(Window.partitionBy(key).orderBy("at"))
    return changed.select(key, *(F.col("value")[c].alias(c) for c in columns), F.col("at").alias("valid_from"), following.alias("valid_to"))


def _first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The observations that differ from the one before, also across spans."""
    last = rows.groupBy(F.col(key).alias("of"), F.col("span").alias("in")).agg(F.max_by("value", "at").alias("latest"))
    before = last.withColumn("entering", F.lag("latest").over(Window.partitionBy("of").orderBy("in"))).drop("latest")
    here = F.lag("value").over(Window.partitionBy(key, "span").orderBy("at"))
    opening = F.row_number().over(Window.partitionBy(key, "span").orderBy("at")) == 1
    met = rows.withColumns({"previous": here, "opening": opening}).join(before, (F.col(key) == F.col("of")) & (F.col("span") == F.col("in")))
    previous: Column = F.when(F.col("opening"), F.col("entering")).otherwise(F.col("previous"))
    return met.where(~F.col("value").eqNullSafe(previous) | previous.isNull()).select(key, "at", "value")
