"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, first doc_id), bucketed and sorted by hash.
Documents come in batches of ascending doc_id; each batch merge-anti-joins the
runs to find its new lines, which become a run of level 0. As soon as ``FANOUT``
runs stand on one level they are merged into one of the next level, so the
number of runs a batch has to meet stays logarithmic. Runs are neither shuffled
nor sorted again: a batch's distinct hashes go to them, and runs are merged
bucket by bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.storage import discard, materialize, new_path

from .common import SPACES, ascii_lower, let, table

#: A batch holds about so many documents, and there are at least so many batches.
BATCH_DOCS, LEAST_BATCHES = 50_000_000, 4
FANOUT = 3
LEAST_CHARS = 10
#: A line that is over this share of a batch's repeated lines is joined by broadcast: there are fewer than 1 / HOT of them.
HOT = 0.001
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made here trust the order within a bucket, which is one file."""
    before = spark.conf.get(_ORDERED, "false")
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDERED, before)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


class Runs:
    """Levels of sorted runs with disjoint hashes."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        #: As many buckets as a shuffle has partitions, so that a shuffled batch meets them as they are.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.compactions = 0

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def _write(self, rows: DataFrame) -> tuple[str, DataFrame]:
        name = f"run_{uuid.uuid4().hex}"
        path = new_path(self.spark, "run")
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name, self.spark.table(name)

    def _drop(self, run: tuple[str, DataFrame]) -> None:
        name, rows = run
        discard(rows)
        self.spark.sql(f"drop table {name}")

    def add(self, rows: DataFrame, level: int = 0) -> None:
        """Rows (h, owner) of new hashes, partitioned by h."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) < self.fanout:
            return
        old, self.levels[level] = self.levels[level], []
        self.add(merge_runs([run for _, run in old]), level + 1)
        self.compactions += 1
        for run in old:
            self._drop(run)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """One run from several with disjoint hashes, by merge joins."""
    return reduce(
        lambda a, b: a.join(b.withColumnRenamed("owner", "other"), "h", "full").select("h", F.coalesce("owner", "other").alias("owner")),
        runs,
    )


def new_hashes(seen: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The rows of ``seen`` (h, ...) whose hash is in no run, by merge anti-joins."""
    return reduce(lambda rows, run: rows.join(run.select("h").hint("merge"), "h", "left_anti"), runs, seen)


def owned(seen: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(h, n, owner, old): ``seen`` with the owner of the run that has the hash, if one has (then ``old``)."""
    for i, run in enumerate(runs):
        seen = seen.join(run.select("h", F.col("owner").alias(f"owner{i}")).hint("merge"), "h", "left")
    first = F.coalesce(F.lit(None), *(F.col(f"owner{i}") for i in range(len(runs))))
    return seen.select("h", "n", F.coalesce(first, "owner").alias("owner"), first.isNotNull().alias("old"))


def _lines(docs: DataFrame) -> DataFrame:
    """Hashes of the lines that count, by document; 16 bytes stand for a line's key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.where("doc_id is not null")
        .select("doc_id", F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= LEAST_CHARS)
        .select("doc_id", "version", "pos", F.unhex(F.md5("key")).alias("h"))
    )


def _batches(docs: DataFrame, n: int) -> list[tuple[int | None, int | None]]:
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    return list(zip(edges, edges[1:], strict=False))


def batch_count(docs: DataFrame, batch_docs: int = BATCH_DOCS) -> int:
    return max(LEAST_BATCHES, -(-docs.count() // batch_docs))


def duplicate_lines(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, version, dropped): positions of the lines that a document loses; no row where it loses none.

    ``version`` is a hash of the text, which tells rows of one doc_id apart.
    Documents without doc_id neither own nor lose lines. ``batches`` changes no result.
    """
    spark = docs.sparkSession
    spans = _batches(docs, batches or batch_count(docs))
    number = reduce(
        lambda rest, i: F.when(F.col("doc_id") <= spans[i][1], F.lit(i)).otherwise(rest),
        range(len(spans) - 2, -1, -1),
        F.lit(len(spans) - 1),
    )
    lines = materialize(_lines(docs).withColumn("batch", number), "lines", partition_by="batch")
    runs, lost = Runs(spark, fanout), []
    with sorted_buckets(spark):
        for i in range(len(spans)):
            batch = lines.where(F.col("batch") == i).drop("batch")
            counted = batch.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"))
            known = runs.all()
            # only lines that stand twice or whose owner is of an earlier batch can be lost
            seen = materialize(owned(counted, known).where("old or n > 1").select("h", "n", "owner"), "seen")
            runs.add(new_hashes(counted.select("h", "owner"), known))
            total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            hot = F.col("n") > HOT * total
            frequent = F.broadcast(seen.where(hot).select("h", "owner"))  # fewer than 1 / HOT rows
            again = batch.join(frequent, "h").unionByName(batch.join(seen.where(~hot).select("h", "owner"), "h"))
            lost.append(materialize(again.where("owner < doc_id").select("doc_id", "version", "pos"), "lost"))
            discard(seen)
    runs.close()
    discard(lines)
    gone = reduce(DataFrame.unionByName, lost)
    return gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))


def _without(text: Column, dropped: Column) -> Column:
    """Struct of the line count, the number dropped and the text that stays."""

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        places = F.array_except(F.sequence(F.lit(0), n - 1), dropped)
        kept = F.when(dropped.isNull(), lines).otherwise(F.transform(places, lambda i: F.get(lines, i)))
        return F.struct(
            n.cast("bigint").alias("n_lines"),
            F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.array_join(kept, "\n").alias("kept_text"),
        )

    return let(F.split(text, "\n"), of_lines)


def _found(docs: DataFrame, batches: int | None, fanout: int) -> DataFrame:
    """(row, lines): the rows of ``docs`` as structs, which no name of theirs can disturb, with what becomes of their lines."""
    carried = docs.select(F.struct("*").alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    gone = duplicate_lines(docs.select("doc_id", "text"), batches, fanout).withColumnRenamed("doc_id", "loser")
    met = (F.col("doc_id") == F.col("loser")) & (F.xxhash64("text") == F.col("version"))
    return carried.join(gone, met, "left").select("row", _without(F.col("text"), F.col("dropped")).alias("lines"))


def dedup_lines(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with a last column ``lines``, in place of one of that name: a struct of n_lines, n_dropped and kept_text.

    A key of at least ten code points found in two or more documents loses all
    its lines except those of its smallest doc_id. Null and empty texts are one
    empty line. Very long texts and lines are read whole. Repeated rows each give
    a row. Rows without doc_id lose nothing. An empty table gives an empty one.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "lines"]
    return _found(docs, batches, fanout).select(*own, "lines")


def drop_repeats(docs: DataFrame, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """The documents without their repeated lines; ``text`` and, if there is one, ``n_chars`` are those of what stays."""
    text = F.when(F.col("lines.n_dropped") > 0, F.col("lines.kept_text")).otherwise(F.col("row")["text"])
    types = dict(docs.dtypes)
    changed = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast(types.get("n_chars", "long"))}
    return _found(docs, batches, fanout).select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the checksum of what stays of every document, one row for each row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept_text").cast("binary"), 256).alias("kept_sha256")
    )
