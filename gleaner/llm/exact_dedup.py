"""Exact dedup by most-significant-digit radix partitioning.

The first digit of a document is its length and its first bytes; each later one
the next bytes, up to ``GROWTH`` times as many as before. A round splits every
group by its next digit, compared as bytes and never as a digest. Documents alone
in their group are done, and so are those whose bytes are used up: their group is
a class of equal texts. Only the others go on, so the tables of later rounds hold
little more than copies, and the number of rounds is that of the digits of the
longest text that another one follows so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import discard, materialize

from .common import ascii_lower, table

#: Bytes of the first digit, the growth from one digit to the next, and the most bytes of a digit.
FIRST, GROWTH, MOST = 64, 16, 1 << 20
ADDED = ("keep_id", "group_size", "kept")


def octets(text: Column, start: int, n: int) -> Column:
    """``n`` bytes of the UTF-8 text from ``start`` on, A-Z in lower case, one character for each byte."""
    part = F.substring(F.coalesce(text, F.lit("")).cast("binary"), start + 1, n)
    return ascii_lower(F.decode(part, "ISO-8859-1"))


def _begin(docs: DataFrame, width: int) -> DataFrame:
    """Split by length and the first bytes: (row, doc_id, size, number, group, open), open where others share both.

    Rows get their number as they are written, so it is the same for all later rounds.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    rows = rows.withColumn("digit", octets(F.col("row")["text"], 0, width))
    counted = rows.groupBy(F.col("size").alias("met"), F.col("digit").alias("same")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own, so that Spark may split the partition of a large group; merged at any size, for no bound holds for it
    shared = materialize(counted, "digits").hint("merge")
    split = rows.join(shared, (F.col("size") == F.col("met")) & (F.col("digit") == F.col("same")), "left")
    number = F.monotonically_increasing_id().alias("number")
    return split.select("row", "doc_id", "size", number, F.col("size").alias("group"), F.col("n").isNotNull().alias("open"))


def _split(rows: DataFrame, start: int, width: int) -> DataFrame:
    """Split groups by the bytes from ``start`` on: as ``_begin``, with the size ``n`` of the group and its ``last``
    doc_id and number.

    The new group is named after its smallest number. Groups are counted before rows meet their count, so that
    the join has one row on its other side, however large a group is.
    """
    rows = rows.select("row", "doc_id", "size", "number", "group", octets(F.col("row")["text"], start, width).alias("digit"))
    counted = rows.groupBy(F.col("group").alias("met"), F.col("digit").alias("same")).agg(
        F.count(F.lit(1)).alias("n"), F.min("number").alias("least"), F.max(F.struct("doc_id", "number")).alias("last")
    )
    groups = materialize(counted, "digits").hint("merge")
    split = rows.join(groups, (F.col("group") == F.col("met")) & (F.col("digit") == F.col("same")))
    more = (F.col("n") > 1) & (F.col("size") > start + width)
    return split.select("row", "doc_id", "size", "number", F.col("least").alias("group"), "n", "last", more.alias("open"))


def mark_copies(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, most: int = MOST) -> DataFrame:
    """``docs`` with the last columns keep_id, group_size and kept, in place of any of these names.

    Texts are equal if they are identical after A-Z is lower-cased; null counts as empty. Of equal texts the row with
    the largest doc_id stays, and its doc_id is the ``keep_id`` of all. A row without doc_id stays only where no row
    of its text has one; of several rows with the largest doc_id one stays. Very long texts are compared whole. An
    empty table gives an empty one. The size of the digits changes no result.
    """
    found = materialize(_begin(docs, first), "radix", "open")
    done = [
        found.where("not open").select(
            "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")
        )
    ]
    start, width = 0, first * growth  # the second digit covers the first again, which names no group
    while not (rows := found.where("open")).isEmpty():
        width = min(width, most)
        found = materialize(_split(rows, start, width), "radix", "open")
        discard(rows, "open=true")
        last = (F.col("number") == F.col("last")["number"]).alias("kept")
        done.append(found.where("not open").select("row", F.col("last")["doc_id"].alias("keep_id"), F.col("n").alias("group_size"), last))
        start, width = start + width, width * growth
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    return reduce(DataFrame.unionByName, done).select(*own, *ADDED)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, columns as they are; a column named like one of the marks is null."""
    kept = mark_copies(docs).where("kept")
    return kept.select(*(f"`{c}`" if c.lower() not in ADDED else F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts of every document, one row for each row; see ``mark_copies`` for odd rows."""
    found = mark_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    normal = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return found.select("doc_id", *ADDED, F.sha2(normal.cast("binary"), 256).alias("text_sha256"))
