"""Pairs of rows from pairs of classes: what is equal is compared once, and its rows are paired without a shuffle of the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a class that one task pairs with as many of another.
TILE = 1000


def row_pairs(members: DataFrame, linked: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b), a < b: the rows of linked classes. ``members``: ord, rep (its class); ``linked``: x, y and in_order.

    A row of class ``x`` is paired with one of ``y``, each pair once; where ``in_order`` only with a larger ordinal. A class that is
    linked with itself gives its own pairs, in order or not. Classes are dealt into tiles, so two large ones are many tasks' work, and a
    pair is written as it is made: it needs neither a sort nor a place to be kept.
    """
    c = F.col
    tiles = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = members.join(tiles, "rep").select("rep", "ord", F.pmod(F.xxhash64("ord"), c("tiles")).cast("int").alias("tile"))
    of = lambda side, n: tiles.select(c("rep").alias(side), c("tiles").alias(n))
    each = lambda first, n: F.explode(F.sequence(first, c(n) - 1))
    met = linked.select("x", "y", "in_order").join(of("x", "xs"), "x").join(of("y", "ys"), "y").select("*", each(F.lit(0), "xs").alias("i"))
    met = met.select("x", "y", "i", each(F.when(c("x") == c("y"), c("i")).otherwise(0), "ys").alias("j"), F.when(c("x") == c("y"), c("i") == c("j")).otherwise(c("in_order")).alias("in_order"))
    # a number of its own, so that few small rows that make many pairs aren't taken together
    spread = met.repartition(int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "i", "y", "j")
    left = spread.join(dealt.select(c("rep").alias("x"), c("tile").alias("i"), c("ord").alias("p")), ["x", "i"])
    both = left.join(dealt.select(c("rep").alias("y"), c("tile").alias("j"), c("ord").alias("q")), ["y", "j"]).where(~c("in_order") | (c("p") < c("q")))
    return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
