"""Dates and times as column expressions; "now" is always a parameter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_RANGE_DAYS = 90
BLOCK_DAYS = 7


def strict_date(text: Column) -> Column:
    """The real date at the start of a text, or null (also for 30 February)."""
    found = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", F.try_to_date(found, "yyyy-MM-dd"))


def within_days(day: Column, now: Column, days: int | None, reject_unknown: bool = False) -> Column:
    """Posted at most ``days`` (with fractions) before ``now``. Unknown dates pass unless told otherwise, as do future ones."""
    if not days or days <= 0:
        return F.lit(True)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / 8.64e10
    return F.coalesce(age <= days, F.lit(not reject_unknown))


def opportunity_status(deadline: Column, now: Column, zone: str = "Europe/Amsterdam") -> Column:
    """``open``, ``expired`` or ``unknown`` for a local date-time text of ``zone``, by comparing texts."""
    local = F.date_format(F.from_utc_timestamp(now, zone), "yyyy-MM-dd'T'HH:mm:ss")
    whole = F.when(F.length(deadline) == 10, F.concat(deadline, F.lit("T23:59:59"))).otherwise(deadline)
    known = F.rlike(F.coalesce(deadline, F.lit("")), F.lit(r"^\d{4}-\d{2}-\d{2}"))
    return F.when(~known, F.lit("unknown")).when(whole < local, F.lit("expired")).otherwise(F.lit("open"))


def publication_range(first: date | None, last: date | None, today: date) -> tuple[date, date]:
    """The range asked for, by default the last two days; refuses one that is reversed or too long."""
    from datetime import timedelta

    end = last or today
    start = first or end - timedelta(days=1)
    if start > end:
        raise ValueError("the range ends before it starts")
    if (end - start).days + 1 > LONGEST_RANGE_DAYS:
        raise ValueError(f"the range is longer than {LONGEST_RANGE_DAYS} days")
    return start, end


def publication_blocks(first: Column, last: Column, days: int = BLOCK_DAYS) -> Column:
    """Array of (block_from, block_to), newest first, that cover the range."""
    ends = F.sequence(last, first, F.expr(f"interval -{days} days"))
    return F.transform(
        ends, lambda e: F.struct(F.greatest(F.date_sub(e, days - 1), first).alias("block_from"), e.alias("block_to"))
    )
