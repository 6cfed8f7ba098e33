"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again for the next one, so a stage that fails can be run again
by itself. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import language_id, line_dedup, packing, quality_rules, simhash
from gleaner.operators.storage import discard, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the learned decision list."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages."""
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~language_id.held_out())
    return language_id.keep_known(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has."""
    return line_dedup.drop_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, as the operator links them: fingerprints of three-word shingles at 3 bits or less.

    Copies and texts with a few words changed go; texts that are merely alike (five-word Jaccard of 0.8) mostly stay, see the README.
    """
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their token ids and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("best-fit packing", pack),
]

#: The learned stages can't be expressed in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        if number:
            discard(before)  # the next stage is written, so nothing reads this one any more
    return docs
