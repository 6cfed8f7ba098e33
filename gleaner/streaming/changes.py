"""Streams: windowed request limits and change detection by content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limits(requests: DataFrame, key: str, at: str, window: str = "15 minutes", most: int = 20, late: str = "1 hour") -> DataFrame:
    """Keys with more than ``most`` requests in a tumbling window; rows later than ``late`` are left out on a stream."""
    return (
        requests.withWatermark(at, late)
        .groupBy(key, F.window(at, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .where(F.col("requests") > most)
        .select(key, F.col("w.start").alias("window_start"), "requests")
    )


def changes(items: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """(key, ord, hash, state) for every item of a stream: new, changed or unchanged against the last hash of its key.

    ``key`` is one thing watched (a page, a record), so a state is one hash. Within a batch items count in ``order``,
    whatever files they come from.
    """
    hashed = items.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.sha2(content, 256).alias("hash"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ord", "hash"], kind="stable")
        before = rows["hash"].shift(fill_value=state.get[0] if state.exists else None)
        rows["state"] = ["new" if b is None else "unchanged" if b == h else "changed" for b, h in zip(before, rows["hash"], strict=True)]
        rows["key"] = key[0]
        state.update((rows["hash"].iloc[-1],))
        yield rows[["key", "ord", "hash", "state"]]

    return hashed.groupBy("key").applyInPandasWithState(
        step, "key string, ord long, hash string, state string", "hash string", "append", GroupStateTimeout.NoTimeout
    )


def write_once(folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch has a folder of its own, so one that is written again after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
