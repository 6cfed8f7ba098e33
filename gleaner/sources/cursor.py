"""A resumable walk over a source in batches, as a Spark data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


@dataclass
class Batch:
    items: list[dict]
    next_cursor: str | None
    exhausted: bool


@dataclass
class Walk:
    items: list[dict] = field(default_factory=list)
    cursor: str | None = None
    reason: str = "exhausted"
    batches: int = 0


def walk(fetch: Callable[[str | None, int], Batch], batch_size: int, most_items: int, most_batches: int, start: str | None = None) -> Walk:
    """Batches until a limit: reason is exhausted, item_limit, batch_limit or no_progress.

    Items are never skipped: a batch that would pass the item limit is asked for with a smaller size. A batch
    larger than asked for is refused.
    """
    out = Walk(cursor=start)
    while True:
        room = min(batch_size, most_items - len(out.items))
        if room <= 0:
            out.reason = "item_limit"
            return out
        if out.batches >= most_batches:
            out.reason = "batch_limit"
            return out
        got = fetch(out.cursor, room)
        if len(got.items) > room:
            raise ValueError("the source returned more than was asked for")
        out.batches += 1
        out.items += got.items
        if got.exhausted:
            out.cursor = got.next_cursor
            return out
        if got.next_cursor == out.cursor:
            out.reason = "no_progress"
            return out
        out.cursor = got.next_cursor


class _NumberReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.total, self.size = int(options.get("total", 100)), int(options.get("batch", 10))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(self.total, start["cursor"] + self.size)
        return iter([(i, f"item-{i}") for i in range(start["cursor"], end)]), {"cursor": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([(i, f"item-{i}") for i in range(start["cursor"], end["cursor"])])


class CursorSource(DataSource):
    """A source whose stream offset is its cursor; options ``total`` and ``batch``. A stand-in for paged interfaces."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return "external_id long, raw string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802, ANN001
        return _NumberReader(self.options)
