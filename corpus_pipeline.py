"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of documents. run() writes each result as Parquet in the shared folder and reads it again for
the next stage, so a lost executor costs one stage's work at most and plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm import language, packing, pii, quality, simhash
from genolake.llm.common import Scratch, bucket, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in which no language has a share of 0.4."""
    return language.accepted(docs, language.learn(docs, bucket("doc_id", 3) != 1))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are unlikely to have a grade above the lowest."""
    return quality.accepted(docs, quality.learn(docs, quality.ratings(table(spark, sf_dir, "labels"))))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: candidates by SimHash and by bands of minima, verified by five-word
    shingles with a similarity of 0.8 or more."""
    return simhash.one_of_similar(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates, addresses and secrets by pseudonyms; drops no row."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens of all documents into sequences."""
    return packing.pack_documents(docs, packing.vocabulary())


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No stage but the fourth can be said in SQL without user code; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
