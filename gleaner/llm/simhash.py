"""SimHash near-duplicates: fingerprints, pigeonring candidates, Hamming check, components.

64 bits in four segments of 16, at most ``DISTANCE`` = 3 differing bits. By the
pigeonring principle two such fingerprints have a segment from which every chain
of l consecutive segments (around the ring) differs in at most 3*l/4 bits: 0 in
the first, 1 in the first two, 2 in the first three. A chain of two is met by an
equi-join: one side gives its two segments, the other the same two with the
second as it is or with one bit flipped. The chain of three and the full distance
are filters on what the join finds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleaner.operators.components import connected_components
from gleaner.operators.storage import materialize

from .common import table

SEGMENTS, WIDTH = 4, 16
DISTANCE = 3
SHINGLE = 3


def simhash(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; zero for null and for a text without words.

    Bytes are lower-cased and split as the ASCII methods of ``bytes`` do: A-Z, and U+0020 and U+0009 to U+000D.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded, however long the text
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


@F.pandas_udf(LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in text], dtype="int64")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - WIDTH * (i % SEGMENTS + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _key(fp: Column, i: int) -> Column:
    """Segment i and the next one, with i in front."""
    return (
        F.lit(i << 2 * WIDTH)
        .bitwiseOR(F.shiftleft(_segment(fp, i), WIDTH))
        .bitwiseOR(_segment(fp, i + 1))
        .cast("bigint")
    )


def close_pairs(reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at distance 1 to 3. ``reps`` is (fp, rep)."""
    flips = F.array(*(F.lit(v).cast("bigint") for v in (0, *(1 << b for b in range(WIDTH)))))
    asks = reps.select(
        F.col("fp").alias("fa"),
        F.col("rep").alias("a"),
        F.explode(F.array(*(_key(F.col("fp"), i) for i in range(SEGMENTS)))).alias("base"),
    ).select("fa", "a", F.explode(F.transform(flips, lambda v: F.col("base").bitwiseXOR(v))).alias("key"))
    has = reps.select(
        F.col("fp").alias("fb"),
        F.col("rep").alias("b"),
        F.explode(F.array(*(_key(F.col("fp"), i) for i in range(SEGMENTS)))).alias("key"),
    )
    start = F.shiftright(F.col("key"), 2 * WIDTH).cast("int")
    differ = F.col("fa").bitwiseXOR(F.col("fb"))
    third = F.lit(False)
    for i in range(SEGMENTS):
        chain = sum(F.bit_count(_segment(differ, i + k)) for k in range(1, 3))
        third = F.when(start == i, chain <= 2).otherwise(third)
    met = asks.join(has, "key").where("a < b")
    return met.where(third & (F.bit_count(differ) <= DISTANCE)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    Documents of one fingerprint are a class with the smallest doc_id for its
    representative; links are sought between representatives only. Null and
    empty texts share fingerprint zero and are linked like any other. A row
    without doc_id has a fingerprint and a null component. Repeated rows give
    repeated results; an empty table gives an empty one. Very long texts are hashed
    whole, in bounded pieces; a bit set in just half the hashes is 0. Further
    columns, whatever their names, are not read.
    """
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")
    reps = materialize(
        prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives"
    )
    found = connected_components(close_pairs(reps), "a", "b")
    classes = materialize(
        reps.join(found, reps["rep"] == found["node"], "left").select(
            F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
        ),
        "classes",
    )
    return prints.join(classes, F.col("fp") == F.col("class_fp"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents without those that follow another of their group; columns as they are.

    Rows without doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, one row for each row."""
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
