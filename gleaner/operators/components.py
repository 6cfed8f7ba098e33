"""Connected components of an edge table, by alternating star contraction.

Each round is two DataFrame steps: every node hands its larger neighbours to
the smallest node it knows (large star), then its smaller neighbours likewise
(small star). Rounds needed grow with the logarithm of the longest path. Both
steps aggregate a minimum per node first, so a hub's neighbours are never
gathered in one task; the join that follows is an ordinary shuffle join whose
skewed partitions adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    moved = down.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, component)`` for every node with a link to another node.

    ``component`` is the smallest node reachable. Edges with a null end and
    self-loops give nothing; an empty table gives an empty table; repeated and
    reversed edges change nothing.
    """
    e = (
        edges.select(F.col(src).alias("x"), F.col(dst).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    e = materialize(e, "edges")
    before = _signature(e)
    while before[0]:
        step = materialize(_large_star(e).where("a <> b").distinct(), "large")
        following = materialize(_small_star(step).where("a <> b").distinct(), "small")
        discard(step)
        after = _signature(following)
        discard(e)
        e = following
        if after == before:
            break
        before = after
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
