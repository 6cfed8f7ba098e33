"""Parts of pages found on the table of nodes: values near a heading, labels and values, an employer's block, parts of a list.

Everything is a join or a window over the numbers of a page's nodes. Sorting and
joining are by page, so a step's work is a page's nodes, times its marked elements
where texts of elements are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import employers as E
from gleaner.functions.dom import TEXT, attr, joined_text, within
from gleaner.functions.dom import nodes as nodes_of
from gleaner.functions.text import collapse
from gleaner.operators.storage import materialize

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Elements and class or id parts that are no content of a record.
NO_CONTENT = ["nav", "footer", "header", "form", "script", "style", "noscript"]
NO_CONTENT_MARKS = "cookie|menu"
NO_CONTENT_CLASSES = "related|similar|relevant"
HIDDEN = ["script", "style", "template", "noscript"]
#: Siblings after the heading's parent whose values count, values that are looked at, and their longest.
REACH, MOST_LEAVES, LONGEST_VALUE = 3, 100, 40
#: The shape of hours, and kinds of contract.
HOURS = r"(?i)^\d{1,3}(?:[.,]\d{1,2})?\s*-?\s*\d{0,3}\s*(?:uur|u|hours?|hrs?)(?:\s*/?\s*(?:per\s*)?(?:week|wk))?$"
CONTRACTS = ["fulltime", "full-time", "full time", "parttime", "part-time", "part time", "voltijd", "deeltijd"]
#: Labels, and the element that holds the value of some.
LABELS, VALUE_OF = ["dt", "th", "label", "strong", "b"], {"dt": "dd", "th": "td"}
#: A heading's part begins at most so many levels above it. Headings in these elements have none.
CLIMB, APART = 8, ["nav", "header", "footer"]
FILES = r"(?i)\.(?:pdf|docx?|xlsx?|zip)$"


def _page() -> Window:
    return Window.partitionBy("page_id").orderBy("pre")


def no_content() -> Column:
    """Whether a node itself begins a part that is no content of a record."""
    marks = F.lower(F.concat_ws(" ", attr("class"), attr("id")))
    return F.col("tag").isin(NO_CONTENT) | F.rlike(marks, F.lit(NO_CONTENT_MARKS)) | F.rlike(F.lower(F.coalesce(attr("class"), F.lit(""))), F.lit(NO_CONTENT_CLASSES))


def texts_of(nodes: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``said``, the text in each span (page_id, first, last, ``keys``) without scripts and styles; none where there is no text."""
    shown = nodes.select("page_id", "pre", "text", within(F.col("tag").isin(HIDDEN)).alias("hidden")).where("text is not null and not hidden")
    met = shown.join(spans.select(F.col("page_id").alias("of"), "first", "last", *(F.col(k).alias(f"k_{k}") for k in keys if k != "page_id")), (F.col("page_id") == F.col("of")) & F.col("pre").between(F.col("first"), F.col("last")))
    return met.groupBy("page_id", *(F.col(f"k_{k}").alias(k) for k in keys if k != "page_id")).agg(joined_text().alias("said"))


def page_context(nodes: DataFrame) -> DataFrame:
    """(page_id, site_name, page_title, heading): names a page gives itself, and the heading that names its record.

    That is the element declared as title, else the first h1, of those that do not only repeat the site's name or a
    part of a page title of several parts.
    """
    tag = F.col("tag")
    spans = nodes.where((tag == "title") | (tag == "h1") | (attr("itemprop") == "title")).select("page_id", F.col("pre").alias("first"), "last", "tag", attr("itemprop").alias("prop"))
    said = texts_of(nodes, spans, ["first"])
    marked = spans.join(said, ["page_id", "first"])
    own = nodes.where((tag == "meta") & (F.lower(attr("property")) == "og:site_name")).groupBy("page_id").agg(F.min_by(collapse(attr("content")), "pre").alias("site_name"))
    title = marked.where("tag = 'title'").groupBy("page_id").agg(F.min_by("said", "first").alias("page_title"))
    names = nodes.select("page_id").distinct().join(own, "page_id", "left").join(title, "page_id", "left")
    parts = F.filter(F.transform(F.split("page_title", r"\s*[-|•–—:]\s*"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    said_low = F.lower("said")
    repeats = F.coalesce(said_low == F.lower("site_name"), F.lit(False)) | F.coalesce((F.size(parts) > 1) & F.array_contains(parts, said_low), F.lit(False))
    declared = F.coalesce(F.col("prop") == "title", F.lit(False))
    ahead = F.min(F.when(declared, F.col("first"))).over(Window.partitionBy("page_id"))
    candidates = marked.withColumn("ahead", ahead).where((F.col("tag") == "h1") | (declared & (F.col("first") == F.col("ahead"))))
    naming = candidates.where("said <> ''").join(names, "page_id").where(~repeats)
    first = naming.groupBy("page_id").agg(F.min_by("first", F.struct((~declared).cast("int"), "first")).alias("heading"))
    return names.join(first, "page_id", "left")


def leaves(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, depth, said): elements without elements in them, with their text."""
    elements = nodes.where(F.col("tag") != TEXT)
    bare = elements.withColumn("inner", F.lead("parent").over(_page())).where(~F.col("inner").eqNullSafe(F.col("pre"))).select("page_id", "pre", "depth", "tag")
    said = nodes.where(F.col("tag") == TEXT).groupBy("page_id", "parent").agg(joined_text().alias("said"))
    return bare.where(~F.col("tag").isin(HIDDEN)).join(said.withColumnRenamed("parent", "pre"), ["page_id", "pre"], "left").select("page_id", "pre", "depth", F.coalesce("said", F.lit("")).alias("said"))


def metadata_block(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """(page_id, hours, contract_type, values) of pages whose record has a heading: what stands near it without a label.

    Near: in the heading's parent or one of the three elements after it. A value is the text of an element without
    elements, at most 40 characters, and only its own shape tells what it is; of several of a shape the first counts.
    ``values`` are all of them in order.
    """
    elements = nodes.where(F.col("tag") != TEXT).select("page_id", "pre", "last", "depth", "parent")
    at = context.where("heading is not null").select("page_id", F.col("heading").alias("pre"))
    heading = elements.join(at, ["page_id", "pre"], "left_semi").select("page_id", F.col("parent").alias("pre"))
    box = elements.join(heading, ["page_id", "pre"]).select("page_id", F.col("pre").alias("first"), F.col("last").alias("end"), F.col("depth").alias("level"), F.col("parent").alias("above"))
    after = elements.join(box, "page_id").where(F.col("parent").eqNullSafe(F.col("above")) & (F.col("pre") > F.col("first")))
    near = after.withColumn("n", F.row_number().over(_page())).where(F.col("n") <= REACH).groupBy("page_id").agg(F.max("last").alias("reach"))
    region = box.join(near, "page_id", "left").select("page_id", "first", "level", F.coalesce("reach", "end").alias("end"))
    inside = leaves(nodes).join(region, "page_id").where("pre > first and pre <= end and depth > level")
    seen = inside.withColumn("n", F.row_number().over(_page())).where(F.col("n") <= MOST_LEAVES).where((F.col("said") != "") & (F.length("said") <= LONGEST_VALUE))
    first = lambda when: F.min_by("said", F.when(when, F.col("pre")))
    found = seen.groupBy("page_id").agg(
        first(F.rlike("said", F.lit(HOURS))).alias("hours"),
        first(F.lower("said").isin(CONTRACTS)).alias("contract_type"),
        F.transform(F.array_sort(F.collect_list(F.struct("pre", "said"))), lambda x: x["said"]).alias("values"),
    )
    return at.select("page_id").join(found, "page_id", "left").select("page_id", "hours", "contract_type", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def label_values(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, label, value): labels and what follows them under the same parent.

    The value of a term or a heading cell is the next definition or cell; of others the next text that says something,
    or else the next element.
    """
    tag = F.col("tag")
    value_tags = F.create_map(*(F.lit(x) for pair in VALUE_OF.items() for x in pair))
    bare = F.trim(F.regexp_replace("text", r"^[\s:]+|[\s:]+$", ""))
    here = F.struct("pre", "last")
    rows = nodes.select("page_id", "pre", "last", "parent", "tag", "text").where("parent is not null")
    ahead = Window.partitionBy("page_id", "parent").orderBy(F.col("pre").desc()).rowsBetween(Window.unboundedPreceding, -1)
    following = lambda when: F.last(F.when(when, here), ignorenulls=True).over(ahead)
    nexts = {v: following(tag == v) for v in VALUE_OF.values()}
    plain = following((tag != TEXT) | (bare != ""))
    wanted = F.try_element_at(value_tags, tag)
    chosen = F.when(wanted.isNull(), plain)
    for v, column in nexts.items():
        chosen = F.when(wanted == v, column).otherwise(chosen)
    found = rows.withColumn("value", chosen).where(tag.isin(LABELS) & F.col("value").isNotNull()).select("page_id", "pre", F.col("last").alias("end"), "value")
    labels = texts_of(nodes, found.select("page_id", "pre", F.col("pre").alias("first"), F.col("end").alias("last")), ["pre"]).withColumnRenamed("said", "label")
    values = texts_of(nodes, found.select("page_id", "pre", F.col("value")["pre"].alias("first"), F.col("value")["last"].alias("last")), ["pre"]).withColumnRenamed("said", "value")
    clean = lambda c: F.trim(F.regexp_replace(c, r"^[\s:]+|[\s:]+$", ""))
    return labels.join(values, ["page_id", "pre"]).select("page_id", "pre", clean(F.col("label")).alias("label"), clean(F.col("value")).alias("value")).where("value <> ''")


def employer_blocks(nodes: DataFrame, context: DataFrame, locations: DataFrame) -> DataFrame:
    """(page_id, block, declared): the employer that a delimited part of the page names, and the one that it declares.

    A block is an element declared as employer, else one whose class or id says that it is the employer's name, else a
    heading "over" or "about" a name that stands in the page's title and not in the job's location (``locations``:
    page_id, location). A declared author counts if the site's name or a logo's text says the same.
    """
    tag, c = F.col("tag"), F.col
    marks = F.lower(F.concat_ws(" ", attr("class"), attr("id")))
    shown = nodes.withColumns({"out": within(no_content()), "prop": attr("itemprop"), "marks": marks})
    kind = F.when(c("prop") == "employer", 0).when(F.rlike("marks", F.lit("|".join(E.NAME_MARKS))), 1).when(tag.isin("h2", "h3"), 2)
    spans = shown.where(~c("out") & (tag != TEXT)).select("page_id", c("pre").alias("first"), "last", kind.alias("kind")).where("kind is not null")
    said = texts_of(nodes, spans, ["first", "kind"])
    # of an employer element the first name in it, if one says something
    names = shown.where(c("prop") == "name").select("page_id", c("pre").alias("first"), "last")
    named = texts_of(nodes, names, ["first"]).withColumnRenamed("first", "at").withColumnRenamed("said", "name")
    owner = spans.where("kind = 0").select("page_id", "first", "last", "kind")
    inner = named.join(owner, "page_id").where("at > first and at <= last").groupBy("page_id", "first", "kind").agg(F.min_by("name", "at").alias("name"))
    about = F.regexp_extract("said", E.ABOUT_HEADING, 1)
    open_about = (about != "") & ~F.rlike(about, F.lit(rf"(?i)^(?:{'|'.join(E.NO_NAME_AFTER_OVER)})(?![A-Za-z0-9_])"))
    candidate = F.when(c("kind") == 2, F.when(open_about, E.company_name(about, E.STRUCTURED))).otherwise(
        E.without_stop(E.company_name(F.coalesce(F.nullif("name", F.lit("")), "said"), E.EXPLICIT))
    )
    every = said.join(inner, ["page_id", "first", "kind"], "left").withColumn("candidate", candidate).where("candidate is not null")
    placed = every.join(context.select("page_id", "page_title"), "page_id").join(locations, "page_id", "left")
    key = E.match_key(c("candidate"))
    confirmed = F.contains(E.match_key(F.coalesce("page_title", F.lit(""))), key) & ~F.contains(E.match_key(F.coalesce("location", F.lit(""))), key)
    blocks = placed.where((c("kind") < 2) | confirmed).groupBy("page_id").agg(F.min_by("candidate", F.struct("kind", "first")).alias("block"))
    author = nodes.where((tag == "meta") & (F.lower(attr("name")) == "author")).groupBy("page_id").agg(F.min_by(collapse(attr("content")), "pre").alias("author"))
    alt = F.coalesce(*(F.nullif(F.regexp_extract(attr("alt"), p, 1), F.lit("")) for p in E.LOGO_OF))
    logos = nodes.where(tag == "img").select("page_id", E.match_key(alt).alias("logo")).where("logo is not null").distinct()
    own = author.withColumns({"name": E.company_name(c("author"), E.STRUCTURED), "key": E.match_key(c("author"))}).where("name is not null")
    seconds = logos.unionByName(context.select("page_id", E.match_key(c("site_name")).alias("logo")).where("logo <> ''")).distinct()
    declared = own.join(seconds, (own["page_id"] == seconds["page_id"]) & (own["key"] == seconds["logo"]), "left_semi").select("page_id", c("name").alias("declared"))
    return context.select("page_id").join(blocks, "page_id", "left").join(declared, "page_id", "left")


def page_parts(nodes: DataFrame) -> DataFrame:
    """(page_id, grouping, ord, first, last, anchor): the parts into which a page may fall, as spans of its nodes.

    A heading's group is the nearest element above it, within eight levels and below the body, of which two or more
    children hold headings; these children are the parts. Groups with more parts come before others, then the one
    whose heading comes first. Last come the runs: of the first of h2, h3 and h4 that stands twice or more, and always
    under one parent, each heading with all that follows up to the next one.
    """
    c, tag = F.col, F.col("tag")
    is_heading = tag.isin(HEADINGS)
    flagged = nodes.withColumn("naming", is_heading & ~within(tag.isin(APART)))
    # headings up to each node; those in an element are the difference over its span
    so_far = F.sum(c("naming").cast("int")).over(_page().rowsBetween(Window.unboundedPreceding, 0))
    every = flagged.select("page_id", "pre", "last", "depth", "parent", "tag", attr("id").alias("id"), "naming", so_far.alias("upto"))
    whole = every.select("page_id", c("pre").alias("last"), c("upto").alias("whole"))
    counted = every.where(tag != TEXT)
    held = counted.join(whole, ["page_id", "last"]).withColumn("held", c("whole") - c("upto") + c("naming").cast("int"))
    parts = held.where("held > 0 and parent is not null")
    forks = parts.groupBy("page_id", "parent").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    boxes = counted.where(~tag.isin("html", "body")).select("page_id", c("pre").alias("parent"), c("last").alias("end"), c("depth").alias("level")).join(forks, ["page_id", "parent"])
    headings = counted.where("naming").select("page_id", c("pre").alias("heading"), "depth")
    above = headings.join(boxes, "page_id").where(c("heading").between(c("parent"), c("end")) & (c("heading") > c("parent")) & (c("depth") - c("level") <= CLIMB))
    nearest = above.groupBy("page_id", "heading").agg(F.max_by("parent", "level").alias("parent"), F.max_by("n", "level").alias("n"))
    groups = nearest.groupBy("page_id", "parent").agg(F.max("n").alias("n"), F.min("heading").alias("heading"))
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(c("n").desc(), "heading")) - 1
    numbered = groups.select("page_id", "parent", order.alias("grouping"))
    within_group = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("pre")) - 1
    cards = parts.join(numbered, ["page_id", "parent"]).select("page_id", "grouping", within_group.alias("ord"), c("pre").alias("first"), "last", c("id").alias("anchor"))
    level = F.when(tag == "h2", 2).when(tag == "h3", 3).when(tag == "h4", 4)
    runs = counted.where("naming and parent is not null").withColumn("rank", level).where("rank is not null")
    fit = runs.groupBy("page_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("low"), F.max("parent").alias("high")).where("n > 1 and low = high").groupBy("page_id").agg(F.min("rank").alias("rank"))
    chosen = runs.join(fit, ["page_id", "rank"]).select("page_id", "pre", "parent", "id")
    parents = counted.select("page_id", c("pre").alias("parent"), c("last").alias("end"))
    until = F.coalesce(F.lead("pre").over(_page()) - 1, c("end"))
    following = chosen.join(parents, ["page_id", "parent"]).select("page_id", (F.row_number().over(_page()) - 1).alias("ord"), c("pre").alias("first"), until.alias("last"), c("id").alias("anchor"))
    after = numbered.groupBy("page_id").agg(F.max("grouping").alias("groups"))
    last = following.join(after, "page_id", "left").select("page_id", F.coalesce(c("groups") + 1, F.lit(0)).alias("grouping"), "ord", "first", "last", "anchor")
    return cards.unionByName(last)


def sections_of(pages: DataFrame) -> DataFrame:
    """``page_sections`` of rows of (page_id, url, html)."""
    tree = materialize(nodes_of(pages), "nodes")
    return page_sections(tree, pages, materialize(page_parts(tree), "parts"))


def page_sections(nodes: DataFrame, pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(page_id, url, grouping, ord, heading, anchor, text, pairs, documents) of the parts of pages (``page_parts``), which several steps read."""
    c, key = F.col, ["page_id", "grouping", "ord"]
    said = texts_of(nodes, parts, ["grouping", "ord"]).withColumnRenamed("said", "text")
    spans = parts.select(*(c(k).alias(f"k_{k}") for k in key), "first", "last")
    inside = lambda rows: rows.join(spans, (c("page_id") == c("k_page_id")) & c("pre").between(c("first"), c("last")))
    marked = nodes.where(c("tag").isin(HEADINGS)).select("page_id", c("pre"), c("last").alias("end"))
    opening = inside(marked).groupBy(*(c(f"k_{k}").alias(k) for k in key)).agg(F.min_by(F.struct("pre", "end"), "pre").alias("h"))
    headings = texts_of(nodes, opening.select(*key, c("h")["pre"].alias("first"), c("h")["end"].alias("last")), ["grouping", "ord"]).withColumnRenamed("said", "heading")
    pairs = inside(label_values(nodes)).groupBy(*(c(f"k_{k}").alias(k) for k in key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pre", "label", "value"))), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("pairs")
    )
    plain = F.substring_index(F.substring_index(attr("href"), "#", 1), "?", 1)
    files = inside(nodes.where((c("tag") == "a") & F.rlike(plain, F.lit(FILES))).select("page_id", "pre", attr("href").alias("href")))
    documents = files.groupBy(*(c(f"k_{k}").alias(k) for k in key)).agg(F.count_distinct("href").cast("int").alias("documents"))
    none = F.array().cast("array<struct<label:string,value:string>>")
    out = parts.select(*key, "anchor").join(pages.select("page_id", "url"), "page_id")
    for more in (said, headings, pairs, documents):
        out = out.join(more, key, "left")
    return out.select("page_id", "url", "grouping", "ord", "heading", "anchor", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("pairs", none).alias("pairs"), F.coalesce("documents", F.lit(0)).alias("documents"))
