"""What the markup of a page declares, and the parts of a page that stand for themselves.

Python hands out nodes and parts of the document tree as rows; what they mean is
worked out by column expressions and grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assess import PATTERNS, date_time, value_of
from .page import parse
from .text import collapse, join_distinct, slugify

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def page_nodes(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, prop, value, said, inside): nodes with an item property, meta and time elements, titles and headings.

    ``value`` is the node's content or datetime attribute, ``inside`` the item properties of the nodes above it.
    """

    def rows_of(page_id: int, html: str | None) -> Iterator[tuple]:
        for i, n in enumerate(parse(html).walk()):
            prop = n.attrs.get("itemprop") or n.attrs.get("property") or n.attrs.get("name")
            if n.tag in ("meta", "time", "title", *HEADINGS) or "itemprop" in n.attrs:
                above, inside = n.parent, []
                while above is not None:
                    if "itemprop" in above.attrs:
                        inside.append(above.attrs["itemprop"])
                    above = above.parent
                yield page_id, i, n.tag, prop, n.attrs.get("content") or n.attrs.get("datetime"), n.text(), inside

    names = ["page_id", "ord", "tag", "prop", "value", "said", "inside"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [r for p in part.itertuples(index=False) for r in rows_of(p.page_id, p.html)]
            yield pd.DataFrame(out, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ord int, tag string, prop string, value string, said string, inside array<string>")


def _first(value: Column, when: Column) -> Column:
    return F.min_by(value, F.when(F.coalesce(when, F.lit(False)) & value.isNotNull() & (value != ""), F.col("ord")))


def declared_facts(nodes: DataFrame) -> DataFrame:
    """(page_id, title, company, location, posted, site_name) from item properties, titles and headings.

    A heading that only repeats the site's name, or a part of a title of several parts, names no record. The title is
    the declared one, else the page's, else the first heading that names something. An address within a job's location
    comes before one anywhere. A posting date is a real one, declared before that of any time element.
    """
    c = F.col
    said = collapse(c("said"))
    at = nodes.groupBy("page_id").agg(
        _first(collapse(c("value")), (c("tag") == "meta") & (c("prop") == "og:site_name")).alias("site_name"),
        _first(said, c("tag") == "title").alias("page_title"),
        F.bool_or(c("prop") == "jobLocation").alias("located"),
        F.array_sort(F.collect_list(F.when(c("tag") == "h1", F.struct("ord", said.alias("h"))))).alias("h1"),
        _first(said, c("prop") == "title").alias("semantic"),
        _first(said, (c("prop") == "name") & F.array_contains("inside", "hiringOrganization")).alias("company"),
        *(_first(said, (c("prop") == p) & F.array_contains("inside", "jobLocation")).alias(f"in_{p}") for p in ("streetAddress", "addressLocality", "addressRegion")),
        *(_first(said, c("prop") == p).alias(p) for p in ("streetAddress", "addressLocality", "addressRegion")),
        _first(F.coalesce("value", "said"), c("prop") == "datePosted").alias("declared"),
        _first(c("value"), c("tag") == "time").alias("timed"),
    )
    parts = F.filter(F.transform(F.split("page_title", r"\s*[-|•–—:]\s*"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    several = F.coalesce(F.size(parts) > 1, F.lit(False))
    generic = lambda h: F.coalesce(F.lower(h) == F.lower(c("site_name")), F.lit(False)) | F.coalesce(several & F.array_contains(parts, F.lower(h)), F.lit(False))
    heading = F.get(F.filter(F.transform("h1", lambda x: x["h"]), lambda h: (h != "") & ~generic(h)), F.lit(0))
    part = lambda p: F.when(c("located"), c(f"in_{p}")).otherwise(c(p))
    day = lambda v: F.try_to_date(F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})(?:T|$)", 1), "yyyy-MM-dd")
    return at.select(
        "page_id",
        F.coalesce(F.when(c("semantic").isNotNull() & ~generic(c("semantic")), c("semantic")), c("page_title"), heading).alias("title"),
        "company",
        join_distinct(F.array(part("streetAddress"), part("addressLocality"), part("addressRegion"))).alias("location"),
        F.coalesce(day(c("declared")), day(c("timed"))).alias("posted"),
        "site_name",
    )


def section_items(sections: DataFrame) -> DataFrame:
    """Procurements written out on one page: (page_id, item, title, reference, deadline, item_url), two or more a page.

    A part counts with a heading of 4 to 200 characters that is no general information and a reference or deadline of
    its own. Of a page's ways to fall apart the first with two such parts is taken. An item is known by its anchor, else
    its reference, else its heading; a second of the same name is -2.
    """
    phrases = lambda name: "(?:" + "|".join(PATTERNS[name]) + ")"
    c = F.col
    number = F.nullif(F.regexp_extract("text", rf"(?i)(?<![A-Za-z0-9_]){phrases('reference')}\s*[:#]?\s*((?:[A-Z0-9][A-Z0-9./-]*)?\d(?:[A-Z0-9./-]*[A-Z0-9])?)", 1), F.lit(""))
    near = F.nullif(F.regexp_extract("text", rf"(?is){phrases('deadline')}(.{{0,120}})", 1), F.lit(""))
    general = F.rlike("heading", F.lit(rf"(?i)(?<![A-Za-z0-9_]){phrases('general')}(?![A-Za-z0-9_])"))
    read = sections.withColumns({"reference": number, "deadline": F.coalesce(date_time(value_of(c("pairs"), "deadline")), date_time(near))})
    good = read.where(F.length("heading").between(4, 200) & ~general & (c("reference").isNotNull() | c("deadline").isNotNull()))
    enough = good.groupBy("page_id", "grouping").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").groupBy("page_id").agg(F.min("grouping").alias("grouping"))
    named = good.join(enough, ["page_id", "grouping"]).withColumn("name", F.coalesce("anchor", "reference", slugify(c("heading"))))
    n = F.row_number().over(Window.partitionBy("page_id", "name").orderBy("ord"))
    return named.withColumn("n", n).select(
        "page_id",
        F.when(c("n") > 1, F.concat_ws("-", "name", c("n").cast("string"))).otherwise(c("name")).alias("item"),
        c("heading").alias("title"),
        "reference",
        "deadline",
        F.when(c("anchor").isNotNull(), F.concat_ws("#", "url", "anchor")).otherwise(c("url")).alias("item_url"),
    )
