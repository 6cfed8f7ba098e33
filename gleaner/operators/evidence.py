"""What several pages or runs say of one thing: contacts, best evidence, change logs, distinct references, counts by value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.functions.url import link_priority

CONTACT_FIELDS = ["email", "phone", "whatsapp", "instagram", "facebook"]
#: A sitemap index is read as far as so many children.
MOST_CHILDREN = 10


def merge_contacts(pages: DataFrame, by: str, path: Column, order: str, fields: list[str] | None = None) -> DataFrame:
    """Per field the value of the page whose path promises contacts most, the earliest of equals; null where no page has one."""
    rank = F.struct(link_priority(path, F.lit("")), F.col(order))
    filled = lambda f: F.when(F.coalesce(F.col(f), F.lit("")) != "", rank)
    return pages.groupBy(by).agg(*(F.min_by(f, filled(f)).alias(f) for f in fields or CONTACT_FIELDS))


def best_evidence(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row of the highest score of each key, the earliest of equals: later ones replace only what they beat."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def change_log(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after): fields that come with another value than is stored; a null one says nothing."""
    s, i = stored.alias("s"), incoming.alias("i")
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("before"), F.col(f"i.{f}").cast("string").alias("after"))
    each = F.array(*(F.when(F.col(f"i.{f}").isNotNull() & ~F.col(f"s.{f}").eqNullSafe(F.col(f"i.{f}")), entry(f)) for f in fields))
    return s.join(i, key).select(key, F.inline(F.array_compact(each)))


def distinct_tokens(tokens: Column) -> Column:
    """Distinct references in order, without those that only extend another: glued text makes such of one."""
    each = F.array_distinct(tokens)
    return F.filter(each, lambda t: ~F.exists(each, lambda o: (o != t) & F.startswith(t, o)))


def counts_by_value(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """For each group a map of value to number of rows for each of the columns, nulls left out."""
    counted = [
        rows.where(F.col(v).isNotNull()).groupBy(by, F.col(v).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(v))
        for v in values
    ]
    return reduce(lambda a, b: a.join(b, by, "full"), counted)


def children_to_read(children: DataFrame, index: str, location: str, order: str, relevant: str) -> DataFrame:
    """``place`` of the first ten children of each sitemap index: those whose path is relevant first, else in their order."""
    path = F.lower(F.regexp_extract(location, "^[^:]+://[^/?#]*([^?#]*)", 1))
    first = children.withColumn("n", F.row_number().over(Window.partitionBy(index).orderBy(order))).where(F.col("n") <= MOST_CHILDREN)
    by = Window.partitionBy(index).orderBy(F.rlike(path, F.lit(relevant)).desc(), "n")
    return first.withColumn("place", F.row_number().over(by)).drop("n")


def allowed_page(url: Column, host: Column) -> Column:
    """http or https without credentials on the host itself, and no binary file."""
    parts = lambda i: F.regexp_extract(url, r"(?i)^(https?)://([^/?#]*)([^?#]*)", i)
    binary = F.rlike(parts(3), F.lit(r"(?i)\.(?:pdf|jpe?g|png|gif|webp|svg|ico|zip|gz|rar|7z|docx?|xlsx?|pptx?|mp[34]|avi|mov|css|js|woff2?|ttf|exe|dmg)$"))
    return (parts(1) != "") & ~F.contains(parts(2), F.lit("@")) & (F.lower(parts(2)) == F.lower(host)) & ~binary
