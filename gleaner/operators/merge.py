"""Merging of facts: fill gaps, latest value that is not null, and the split of incoming against stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free_name(base: str, *tables: DataFrame) -> str:
    """``base``, with as many underscores behind it as make it a name that no table has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while base in taken:
        base += "_"
    return base


def fill_missing(primary: DataFrame, secondary: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field of ``primary``, or where it is null that of the row of ``secondary`` with the same key."""
    other = free_name("other", primary)
    joined = primary.join(secondary.select(F.struct(key, *fields).alias(other)), F.col(key) == F.col(other)[key], "left")
    return joined.select(*(F.coalesce(F.col(c), F.col(other)[c]).alias(c) if c in fields else F.col(c) for c in primary.columns))


def latest_non_null(rows: DataFrame, keys: list[str], order: Column, picked: list[str], latest: list[str]) -> DataFrame:
    """One row per key: ``picked`` fields from the latest row where they are not null, ``latest`` fields from the
    latest row even where they are null. ``order`` is greatest for the latest row and unique within a key.
    """
    out = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in picked]
    out += [F.max_by(F.struct(f), order)[f].alias(f) for f in latest]
    return rows.groupBy(*keys).agg(*out)


def publication_order(day: Column, number: Column) -> Column:
    """Order of publications: by date (unknown is oldest), then by number where it is one, then as text."""
    return F.struct(
        F.coalesce(day, F.lit("")).alias("day"),
        F.coalesce(number.try_cast("double"), F.lit(0.0)).alias("n"),
        number.alias("text"),
    )


def split_upsert(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], order: str, last_stored_wins: bool = False) -> DataFrame:
    """Incoming rows with ``action``: new, updated (a field that is not null differs) or unchanged, and ``stored_order``.

    Of stored rows with one key the first counts, or the last. Fields that come
    as null keep what is stored.
    """
    row, action, place = free_name("known", incoming), free_name("action", incoming), free_name("stored_order", incoming)
    number = free_name("number", stored)
    by = F.col(order).desc() if last_stored_wins else F.col(order).asc()
    kept = (
        stored.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(by)))
        .where(F.col(number) == 1)
        .select(F.struct(F.col(key).alias("key"), F.col(order).alias("order"), F.struct(*fields).alias("fields")).alias(row))
    )
    known = F.col(row)
    joined = incoming.join(kept, F.col(key) == known["key"], "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f).isNotNull() & ~F.col(f).eqNullSafe(known["fields"][f]))
    what = F.when(known["key"].isNull(), F.lit("new")).when(differs, F.lit("updated")).otherwise(F.lit("unchanged"))
    merged = [F.coalesce(F.col(c), known["fields"][c]).alias(c) if c in fields else F.col(c) for c in incoming.columns]
    return joined.select(*merged, what.alias(action), known["order"].alias(place))


def apply_upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that nothing replaces, and all incoming ones (one per key)."""
    condition = [stored[k].eqNullSafe(incoming[k]) for k in keys]
    return stored.join(incoming, condition, "left_anti").unionByName(incoming)
