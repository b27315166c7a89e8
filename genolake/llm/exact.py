"""Operator 12: exact duplicates by a 128-bit hash of the normalised text, compared byte by byte where hashes are equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import Scratch, table

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, " ")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Groups are the rows whose normalised texts have the same digest (128 bits) and the same bytes: the aggregation's key is
    the digest with the text itself, so texts of one digest are compared where they meet, and a collision makes two groups.
    Copies are combined in each task before the shuffle, so a group of any size sends one row a task. keep_id is the least
    doc_id of the group (null only if all its ids are null); of rows that repeat that id and text, the first written stays.
    The rows find their group by digest and SHA-256 of the text; two different texts alike in both would be an error.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("t"))
    t = t.withColumn("h", digest("t"))
    rows = t.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", F.sha2("t", 256).alias("sha"))
    rows = scratch.save(rows, "rows")
    texts = t.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = scratch.save(texts.select("h", F.sha2("t", 256).alias("sha"), "keep_id", "group_size"), "groups")
    one = F.when(F.count("*") == 1, F.min("keep_id")).otherwise(F.raise_error(F.lit("two texts with the same digests")).cast("long"))
    groups = texts.groupBy("h", "sha").agg(one.alias("keep_id"), F.min("group_size").alias("group_size"))
    firsts = rows.groupBy("h", "sha", "doc_id").agg(F.min("row").alias("first"))
    groups = groups.alias("g").join(firsts.alias("f"), (F.col("g.h") == F.col("f.h")) & (F.col("g.sha") == F.col("f.sha")) & F.col("g.keep_id").eqNullSafe(F.col("f.doc_id")))
    groups = scratch.save(groups.select("g.h", "g.sha", "keep_id", "group_size", "first"), "kept")
    found = rows.join(groups, ["h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the kept row of each group of equal texts (see exact_duplicates()) and all columns. Rows of docs that repeat
    both id and text are one row afterwards: the first of them."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    mine = F.sha2(normalised(F.col("text").cast("string")), 256)
    found = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (mine == F.col("_sha")))
    return found.drop("_id").dropDuplicates(["doc_id", "_sha"]).drop("_sha")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_duplicates() of all rows of documents; see there for nulls, repeats and ties."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM texts
"""
