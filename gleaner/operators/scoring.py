"""Rule scoring: points of the rules that fire, clamped, with an optional cap and reasons by sign."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``points`` apply where ``applies`` is true; a rule of 0 points fires without being for or against."""

    id: str
    applies: Column
    points: int | Column


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def score(
    rules: list[Rule], low: int = 0, high: int = 100, cap: Callable[[Column], Column] | None = None
) -> Column:
    """Struct of score, fired, positive and negative (rule ids in the order given)."""
    fired = F.array_compact(
        F.array(
            *(
                F.when(
                    F.coalesce(r.applies, F.lit(False)),
                    F.struct(F.lit(r.id).alias("id"), (F.lit(r.points) if isinstance(r.points, int) else r.points).cast("int").alias("points")),
                )
                for r in rules
            )
        )
    )
    total = clamp(F.aggregate(fired, F.lit(0), lambda a, x: a + x["points"]), low, high)
    capped = clamp(cap(total), low, high) if cap else total
    names = lambda keep: F.transform(F.filter(fired, keep), lambda x: x["id"])
    return F.struct(
        capped.alias("score"),
        names(lambda x: F.lit(True)).alias("fired"),
        names(lambda x: x["points"] > 0).alias("positive"),
        names(lambda x: x["points"] < 0).alias("negative"),
    )


def present_and_missing(signals: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Names of the signals that hold, and of those that don't, in order."""
    present = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in signals)))
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in signals)))
    return present, missing
