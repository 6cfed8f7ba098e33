"""Importance resampling towards a target corpus, over hashed n-grams.

Every document's words and pairs of neighbouring words are exploded and hashed
into ``BUCKETS`` buckets. A bucket's gain is the log ratio of its smoothed share in
the target and in the whole corpus; a document's weight is the mean gain of its
features. A Gumbel draw that only the document's id decides is added, and the
highest scores are the sample. Everything is a column expression: two passes over
the texts, one join with the table of gains, which has ``BUCKETS`` rows at most, and
one sort by ranges in which every partition numbers its rows from its own offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import table
from .license_scan import words_of

BUCKETS = 10_000
#: Share of the eligible documents that is drawn, in per cent, and the fewest words an eligible one has.
PERCENT, LEAST_WORDS = 25, 20
SEED = 7
#: Gains and draws are kept in thousandths.
SCALE = 1000
#: Of the number that ``monotonically_increasing_id`` gives, the lower bits count the rows of a partition.
PLACE_BITS = 33


def features(words: Column) -> Column:
    """All words, then all pairs of neighbouring words."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def bucket(feature: Column) -> Column:
    return F.crc32(feature.cast("binary")) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that any falls into."""
    words = texts.select(words_of(F.col("text")).alias("words"))
    return words.select(F.explode(features(F.col("words"))).alias("feature")).groupBy(bucket(F.col("feature")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of the buckets that documents use, in thousandths."""
    source = bucket_counts(docs).withColumnRenamed("n", "s")
    wanted = bucket_counts(target).select(F.col("bucket").alias("met"), F.col("n").alias("t"))
    counts = materialize(
        source.join(wanted, F.col("bucket") == F.col("met"), "full").select(
            F.coalesce("bucket", "met").alias("bucket"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")
        ),
        "bucket-counts",
    )
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    above = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + BUCKETS))
    below = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + BUCKETS))
    return counts.select("bucket", F.floor(SCALE * F.log(above / below)).alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The draw of a document, in thousandths; null without doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every row; ``row`` is a number of its own.

    Of n words come n and n - 1 features, so the number of words is told from that of features, and no more than
    ``row`` and ``doc_id`` goes along with each.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    each = texts.select("row", "doc_id", F.explode_outer(features(F.col("words"))).alias("feature"))
    gain = F.broadcast(gains(docs, target).withColumnRenamed("bucket", "known"))  # at most BUCKETS rows
    met = each.withColumn("bucket", bucket(F.col("feature"))).join(gain, F.col("bucket") == F.col("known"), "left")
    summed = met.groupBy("row", "doc_id").agg(F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    weight = F.expr("(total - pmod(total, greatest(n_features, 1))) div greatest(n_features, 1)")
    return summed.select("row", "doc_id", F.expr("(n_features + 1) div 2").alias("n_words"), "n_features", weight.alias("weight")).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"), seed)
    )


def ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (from 1) in the order of ``keys``, which must part all rows, and ``of``, their number.

    The rows are sorted by ranges; each partition numbers its own, and the sums of the partitions before it are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    ordered = materialize(
        placed.withColumn("part", F.shiftright("place", PLACE_BITS)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))), "ordered"
    )
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.orderBy("part")  # one row for each partition of the sort
    before = sizes.select(
        F.col("part").alias("number"),
        (F.sum("n").over(whole) - F.col("n")).alias("before"),
        F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("of"),
    )
    return ordered.join(F.broadcast(before), F.col("part") == F.col("number")).select(
        *rows.columns, (F.col("before") + F.col("place") + 1).alias("rank"), "of"
    )


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for those that are not drawn.

    ``docs`` has doc_id and text, ``target`` text. Eligible are rows with a doc_id and at least ``LEAST_WORDS`` words;
    ``percent`` of their number, rounded down, are drawn. Null and empty texts have no features and weight 0. A row without
    doc_id has no score and is not eligible. Of equal scores the smaller doc_id comes first; repeated rows are ranked
    one after the other. Very long texts are read whole. An empty table gives an empty one, an empty target gains that
    only the corpus decides. Further columns, whatever their names, are not read.
    """
    scored = materialize(scores(docs, target, seed), "scores")
    can = F.col("score").isNotNull() & (F.col("n_words") >= LEAST_WORDS)
    order = ranked(scored.where(can), [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()])
    most = F.expr(f"(of * {percent}) div 100")
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = order.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~can).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def keep_drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The documents that ``resample`` draws, columns as they are; rows of one doc_id stay or go together."""
    chosen = resample(docs, target, percent, seed).where("rank is not null").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the texts of ``benchmark``; see ``resample`` for odd rows."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
