"""Embedding near-duplicates by collision counting on sorted projections.

Unit vectors are projected on the axes of a random orthonormal basis and sorted
along each. A query's window on an axis holds the vectors within ``w`` of it, and
a pair's collisions are the windows it shares. The count needed is calibrated to
lose no link: the squared differences over any axes sum to at most the squared
distance d*d = 2 - 2*cosine, so a pair within d can miss fewer than d*d/(w*w)
windows. Pairs that reach the count are verified by their cosine.

Equal vectors are one class before any pair is formed. The classes of a label
with more than ``BLOCK_ROWS`` are dealt into cells of two projections, on the axes
along which a bounded sample of vectors varies most, and runs of cells into
blocks of about that many. Blocks farther apart than a link can be long are never
compared: a projection only shortens distances, so nothing is lost. A task compares two
blocks and returns for each class its links and a spanning forest, never the
pairs themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleaner.operators.components import connected_components
from gleaner.operators.storage import materialize

from .common import table

COSINE = 0.93
BLOCK_ROWS = 4096
#: Vectors, taken by hash, that the axes of the cells are fitted on; which axes they are changes no result.
SAMPLE_VECTORS = 2000
SEED = 42
#: Axes that windows are counted on, and queries that are counted at once.
COUNTED, TOGETHER = 32, 32


def basis(dimension: int, seed: int = SEED) -> np.ndarray:
    """An orthonormal matrix, the same for a seed everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def calibrate(axes: int, cosine: float) -> tuple[float, int]:
    """Half-width of a window, and the collisions on ``axes`` axes that every pair of at least ``cosine`` has."""
    misses = 3 * axes // 8
    distance = math.sqrt(max(0.0, 2 - 2 * cosine))
    return distance / math.sqrt(misses + 1) * (1 + 1e-9) + 1e-9, axes - misses


def _units(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def compare_blocks(
    x: np.ndarray, y: np.ndarray, cosine: float, same: bool, window: float | None = None
) -> list[tuple[int, np.ndarray]]:
    """For each row of ``x`` with links: the rows of ``y`` it is linked with (later ones only if ``same``).

    A window is a run of places on a sorted axis, so a collision is one comparison of places.
    """
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    axes = min(COUNTED, x.shape[1])
    turn = basis(x.shape[1])[:, :axes]
    half, needed = calibrate(axes, cosine)
    half = half if window is None else window
    px, py = (x / nx[:, None]) @ turn, (y / ny[:, None]) @ turn
    kind = np.uint16 if len(y) < 1 << 16 else np.uint32
    places = np.empty((axes, len(y)), kind)
    low, wide = np.empty((len(x), axes), kind), np.empty((len(x), axes), kind)
    for j in range(axes):
        order = np.argsort(py[:, j], kind="stable")
        places[j, order] = np.arange(len(y), dtype=kind)
        line = py[order, j]
        low[:, j] = np.searchsorted(line, px[:, j] - half, "left")
        wide[:, j] = np.searchsorted(line, px[:, j] + half, "right") - low[:, j]
    found = []
    hits = np.empty((TOGETHER, len(y)), np.uint8)
    apart = np.empty((TOGETHER, len(y)), kind)
    inside = np.empty((TOGETHER, len(y)), bool)
    for start in range(0, len(x), TOGETHER):
        n = min(TOGETHER, len(x) - start)
        hits[:n] = 0
        for j in range(axes):
            # places before the window wrap around to large numbers
            np.subtract(places[j], low[start : start + n, j, None], out=apart[:n])
            np.less(apart[:n], wide[start : start + n, j, None], out=inside[:n])
            hits[:n] += inside[:n].view(np.uint8)
        for i in range(start, start + n):
            close = np.nonzero(hits[i - start] >= needed)[0]
            if same:
                close = close[close > i]
            if len(close):
                close = close[(y[close] @ x[i]) / (ny[close] * nx[i]) >= cosine]
            if len(close):
                found.append((i, close))
    return found


def _links(cosine: float):
    def step(group: pd.DataFrame) -> pd.DataFrame:
        """Linked copies of each class here, and the smallest class of its component here."""
        same = bool(group["same"].iloc[0])
        group = group.sort_values("rep")
        left = group if same else group[group["side"] == 0]
        right = group if same else group[group["side"] == 1]
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "linked": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if left.empty or right.empty:
            return empty
        shift = 0 if same else len(left)
        reps = left["rep"].to_numpy() if same else np.concatenate([left["rep"], right["rep"]])
        many = left["copies"].to_numpy() if same else np.concatenate([left["copies"], right["copies"]])
        linked = np.zeros(len(reps), np.int64)
        root = np.arange(len(reps))
        for i, close in compare_blocks(_units(left["embedding"]), _units(right["embedding"]), cosine, same):
            close = close + shift
            linked[i] += many[close].sum()
            linked[close] += many[i]
            roots = np.unique(np.append(root[close], root[i]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
        there = np.nonzero(linked)[0]
        if not len(there):
            return empty
        smallest = pd.Series(reps).groupby(root).transform("min").to_numpy()
        return pd.DataFrame({"rep": reps[there], "linked": linked[there], "root": smallest[there]})

    return step


def cell_axes(classes: DataFrame, sample: int = SAMPLE_VECTORS) -> np.ndarray:
    """(dimension, 2): orthonormal axes of greatest variance among at most ``sample`` vectors of the commonest dimension there."""
    rows = [r.embedding for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()]
    if not rows:
        return basis(2)
    size = max({len(r) for r in rows}, key=lambda n: (sum(len(r) == n for r in rows), n))
    x = np.array([r for r in rows if len(r) == size])
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=True)
    return axes[:2].T if size > 1 else np.array([[1.0, 0.0]])


def cell_of(axes: np.ndarray, width: float):
    """Column function: a vector's cell on two axes (those of a basis for vectors of another dimension)."""

    @F.pandas_udf("cx int, cy int")
    def of(vectors: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(vectors), 2), np.int64)
        sizes = vectors.map(len).to_numpy()
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            x = _units(vectors.iloc[at])
            own = axes if len(axes) == size else basis(int(size))[:, :2]
            cells = np.floor((x / np.sqrt((x * x).sum(axis=1))[:, None]) @ own / width).astype(np.int64)
            out[at, : cells.shape[1]] = cells
        return pd.DataFrame({"cx": out[:, 0], "cy": out[:, 1]})

    return of


def block_pairs(runs: DataFrame, cosine: float, width: float) -> DataFrame:
    """Pairs of blocks to compare, (label, axes, a, b), a before b or the same.

    ``runs``: label, axes, run, subs and the cells x0 to x1 and y0 to y1 that it spans. A label has no more runs than
    cells, whose number depends on the cosine only; a run of one full cell has as many blocks (``subs``) as it needs.
    """
    at = lambda side: [F.col(c).alias(f"{side}{c}") for c in ("run", "subs", "x0", "x1", "y0", "y1")]
    both = runs.select("label", "axes", *at("a")).join(runs.select("label", "axes", *at("b")), ["label", "axes"]).where("arun <= brun")
    gap = lambda c: F.greatest(F.lit(0), F.col(f"a{c}0") - F.col(f"b{c}1") - 1, F.col(f"b{c}0") - F.col(f"a{c}1") - 1) * width
    near = both.where(gap("x") * gap("x") + gap("y") * gap("y") <= (2 - 2 * cosine) * (1 + 1e-9))
    subs = lambda side: F.sequence(F.lit(0), F.col(f"{side}subs") - 1)
    each = near.withColumn("asub", F.explode(subs("a"))).withColumn("bsub", F.explode(subs("b"))).where("arun < brun or asub <= bsub")
    block = lambda side: F.struct(F.col(f"{side}run").alias("run"), F.col(f"{side}sub").alias("sub")).alias(side)
    return each.select("label", "axes", block("a"), block("b"))


def dealt_blocks(classes: DataFrame, cosine: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The classes (label, axes, embedding, rep, copies) with their block, and the pairs of blocks to compare.

    Cells in order are put together into runs of about ``block_rows``; a fuller cell is a run by itself, dealt by hash.
    A label that fits into one block has a single cell, so that small labels make one task.
    """
    width = math.sqrt(max(1e-6, 2 - 2 * cosine)) / 2
    sizes = classes.groupBy("label", "axes").agg(F.count(F.lit(1)).alias("n"))
    cell = F.when(F.col("n") > block_rows, cell_of(cell_axes(classes), width)(F.col("embedding")))
    origin = F.struct(F.lit(0).alias("cx"), F.lit(0).alias("cy"))
    placed = materialize(classes.join(sizes, ["label", "axes"]).withColumn("cell", F.coalesce(cell, origin)).drop("n"), "cells")
    counted = placed.groupBy("label", "axes", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label", "axes").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = F.col("n") > block_rows
    # full cells take the odd numbers of their own, the others share the even ones
    run = F.when(full, 2 * F.col("before") + 1).otherwise(2 * block_rows * F.floor(F.col("before") / block_rows))
    cells = materialize(counted.withColumn("before", before).select("label", "axes", "cell", "n", run.alias("run")), "runs")
    corners = [f("cell." + c).alias(n) for f, c, n in ((F.min, "cx", "x0"), (F.max, "cx", "x1"), (F.min, "cy", "y0"), (F.max, "cy", "y1"))]
    subs = F.when(F.col("run") % 2 == 1, F.ceil(F.sum("n") / block_rows)).otherwise(1).cast("int")
    runs = cells.groupBy("label", "axes", "run").agg(subs.alias("subs"), *corners)
    pairs = materialize(block_pairs(runs, cosine, width), "block-pairs")
    own = placed.join(cells.join(runs.select("label", "axes", "run", "subs"), ["label", "axes", "run"]), ["label", "axes", "cell"])
    block = F.struct("run", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int").alias("sub")).alias("block")
    return own.select("label", "axes", block, "rep", "copies", "embedding"), pairs


def usable(vector: Column) -> Column:
    """True for a vector without null or non-finite components that is not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & finite & F.exists(vector, lambda v: v != 0)


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows of (vec_id, embedding, label).

    Only vectors of one label and dimension are compared. Those that are null,
    zero or hold null or non-finite components, and those without label or vec_id,
    link with nothing and are their own component. Equal vectors of a label link
    with each other. Repeated rows give repeated results and count once as a link.
    Very long vectors are compared whole; a cosine of just the limit is a link. An
    empty table gives an empty one; further columns, whatever their names, are not read.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where("vec_id is not null and label is not null").where(usable(F.col("embedding")))
    reps = materialize(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")),
        "vectors",
    )
    members, pairs = dealt_blocks(reps.withColumn("axes", F.size("embedding")), cosine, block_rows)
    fields = ["label", "axes", "a", "b", (F.col("a") == F.col("b")).alias("same")]
    sent = lambda side, of: members.join(of.withColumn("block", F.col("ab"[side])), ["label", "axes", "block"]).select(
        *fields, F.lit(side).alias("side"), "rep", "copies", "embedding"
    )
    both = sent(0, pairs).unionByName(sent(1, pairs.where("a <> b")))
    links = materialize(
        both.groupBy("label", "axes", "a", "b").applyInPandas(_links(cosine), "rep long, linked long, root long"), "links"
    )
    components = connected_components(links, "rep", "root")
    totals = links.groupBy(F.col("rep").alias("linked_rep")).agg(F.sum("linked").alias("linked"))
    classes = materialize(
        reps.join(totals, F.col("rep") == F.col("linked_rep"), "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("class_label"),
            F.col("embedding").alias("class_vector"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "classes",
    )
    own = (
        (F.col("label") == F.col("class_label"))
        & (F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding")) == F.col("class_vector"))
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(classes, own, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, one row for each row of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
