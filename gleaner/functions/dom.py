"""Pages as tables of nodes, and what intervals of such a table tell.

A node has the number at which its start tag stands (``pre``) and the largest number
within it (``last``), so ``a`` lies in ``b`` if ``b.pre <= a.pre <= b.last``. Python
only numbers the nodes; which node is inside which, nearest or next is told by windows
over the numbers of a page and by joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements without content, and elements that an element of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = frozenset("p li dt dd tr td th option".split())
#: An element of these kinds keeps what is in it apart: a new item in it ends none outside.
HOLDS = frozenset("ul ol dl table select div section article body".split())
TEXT = "#text"


class _Numbers(HTMLParser):
    """Rows of [pre, last, depth, parent, tag, attributes, text]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []

    def _add(self, tag: str, attrs: list, text: str | None) -> int:
        n = len(self.rows)
        self.rows.append([n, n, len(self.open), self.open[-1] if self.open else None, tag, attrs, text])
        return n

    def _close(self, down_to: int) -> None:
        for n in self.open[down_to:]:
            self.rows[n][1] = len(self.rows) - 1
        del self.open[down_to:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS:
            for at in range(len(self.open) - 1, -1, -1):
                above = self.rows[self.open[at]][4]
                if above == tag or above in HOLDS:
                    if above == tag:
                        self._close(at)
                    break
        n = self._add(tag, [(k, v or "") for k, v in dict(attrs).items()], None)
        if tag not in VOID:
            self.open.append(n)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]][4] == tag:
                self._close(at)
                break

    def handle_data(self, data: str) -> None:
        self._add(TEXT, [], data)


def number_nodes(html: str | None) -> list[list]:
    parser = _Numbers()
    parser.feed(html or "")
    parser.close()
    parser._close(0)
    return parser.rows


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, pre, last, depth, parent, tag, attrs, text) for the nodes of rows of (page_id, html).

    Elements have attributes, text nodes (``#text``) their text with references decoded. ``page_id`` is unique. A
    null or empty page has no nodes. Tags that are never closed end with what holds them.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
    names = ["pre", "last", "depth", "parent", "tag", "attrs", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = number_nodes(batch.column("html")[i].as_py())
                if rows:
                    page = batch.column("page_id").take(pa.array([i] * len(rows)))
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([page, *columns], ["page_id", *names])

    schema = f"page_id {kind}, pre int, last int, depth int, parent int, tag string, attrs map<string,string>, text string"
    return pages.select("page_id", "html").mapInArrow(run, schema)


def attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def _so_far() -> Window:
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)


def within(what: Column) -> Column:
    """Whether a node is, or lies in, one that ``what`` holds for: the farthest end of such nodes so far is not before it."""
    return F.coalesce(F.max(F.when(what, F.col("last"))).over(_so_far()) >= F.col("pre"), F.lit(False))


def holder(what: Column) -> Column:
    """``pre`` of the nearest node that ``what`` holds for and that the node lies in, for kinds of node that don't nest."""
    nearest = F.last(F.when(what, F.struct("pre", "last")), ignorenulls=True).over(_so_far())
    return F.when(nearest["last"] >= F.col("pre"), nearest["pre"])


def joined_text(order: str = "pre", text: str = "text") -> Column:
    """An aggregate: the texts in order, white space collapsed. It is as long as a page at most."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
