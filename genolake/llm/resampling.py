"""Operator 13: documents drawn towards a target by importance weights of hashed features, summed over bit planes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolake.llm.common import Scratch, small_batches, table
from genolake.plans.numbering import numbered

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of a word (lower case): digits, letters, and all of UTF-8 beyond ASCII. Others separate.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Planes are whole 64-bit words.
WIDTH = -(-BUCKETS // 64) * 64


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each feature of a text: its words, then its pairs of consecutive words joined by a space. A pair's
    checksum goes on from that of its first word and the space."""
    words = (text or "").encode().lower().translate(WORD_BYTES).split()
    crc = zlib.crc32
    ones = [crc(w) for w in words]
    pairs = [crc(w, crc(b" ", c)) for c, w in zip(ones, words[1:], strict=False)]
    return np.array(ones + pairs, np.int64) % BUCKETS


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """The lowest n bits of the values (two's complement), a row of packed 64-bit words for each bit."""
    bits = (values[None, :] >> np.arange(n, dtype=values.dtype)[:, None]) & values.dtype.type(1)
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


class Gains:
    """Gains of the buckets as signed bit planes: of plane k the value is 2^k, of the last one -2^k."""

    def __init__(self, gains: list[int]):
        n = max(int(g if g >= 0 else ~g).bit_length() for g in gains) + 1
        self.planes = planes(np.array([*gains, *[0] * (WIDTH - len(gains))], np.int64), n)
        self.values = [1 << k for k in range(n - 1)] + [-(1 << (n - 1))]

    def total(self, found: np.ndarray) -> int:
        """Sum of the gains of the buckets found, repeats counted: counts as planes too, each ANDed with each plane of the
        gains; the bits that are left are counted and summed by powers of two. Exact at any length."""
        counts = np.bincount(found, minlength=WIDTH)
        most = int(counts.max())
        counts = counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)
        of_counts = planes(counts, most.bit_length())
        left = np.bitwise_count(of_counts[:, None, :] & self.planes[None, :, :]).sum(2, dtype=np.int64)
        return sum(int(x) * v << k for k, row in enumerate(left) for x, v in zip(row, self.values, strict=True))


def bucket_counts(texts: DataFrame) -> list[int]:
    """How often each bucket occurs in all texts(text). Each task sends at most one number a bucket, and the driver gets
    BUCKETS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                counts += np.bincount(buckets(t), minlength=BUCKETS)
        at = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) for each bucket."""
    s_all, t_all = sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + float(BUCKETS)) / ((s + 1.0) * (t_all + float(BUCKETS))))) for s, t in zip(source, target, strict=True)]


def weighed(docs: DataFrame, gains: list[int]) -> DataFrame:
    """(doc_id, n_features, weight): the floored mean of the gains of a document's features; 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Gains(gains)
        for b in batches:
            found = [buckets(t) for t in b.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            weights = [of.total(x) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank from 1 for those drawn, else null.

    A document's weight is the mean gain of its features, from counts over all docs and all target texts. The highest
    `percent` of 100 of the documents with enough words are drawn by weight plus Gumbel noise from the doc_id, so the draw is
    one without replacement in proportion to the exponential of weight. Ties go to the smaller doc_id, then to the fewer
    features and the smaller weight; null ids come last and have the noise of an empty id. Null and empty texts have no
    features and are never drawn. Repeated rows are ranked each. The ranking is a distributed sort.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "resampling")
    rows = scratch.save(weighed(docs, gains_of(bucket_counts(docs), bucket_counts(target))), "weights")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    rows = rows.withColumn("score", F.col("weight") + noise)
    enough = F.col("n_features") >= 2 * least_words - 1  # w words have 2w - 1 features
    drawn = rows.where(enough).count() * percent // 100
    ordered = numbered(rows.where(enough).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"), "place")
    cols = ["doc_id", "n_features", "weight", "score"]
    ranked = ordered.select(*cols, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    return ranked.union(rows.where(~enough).select(*cols, F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resampled() of all documents towards all benchmark texts; see there for nulls, ties and repeats."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
