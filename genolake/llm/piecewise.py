"""Operator 9: context-triggered piecewise hashes and their likeness."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from genolake.llm.common import small_batches, table

WINDOW = 7
SIGNATURE, SIZES = 64, 3
#: The two levels above the last one still have thresholds over 0.
LEAST_LEVEL, LAST_LEVEL = 2, 29
#: Added to each window's sum, so that a run of NULs does not hash to 0.
OFFSET = 0x7F4A7C15
BLOCK_BYTES = 1 << 22
#: One multiplier for each byte of the window, made by a rule: odd 32-bit numbers from powers of 0x9E3779B1.
FACTORS = [np.uint32(pow(0x9E3779B1, k + 1, 1 << 32) | 1) for k in range(WINDOW)]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the last 7 bytes at each byte (zeros before the start, if data has none in front)."""
    x = data.astype(np.uint32)
    out = x * FACTORS[0]
    for k in range(1, WINDOW):
        if k < len(x):
            out[k:] += x[:-k] * FACTORS[k]
    out += np.uint32(OFFSET)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    out *= np.uint32(0xC2B2AE35)
    return out


def fingerprint(text: bytes) -> str:
    """`level:signature:signature at double size:signature at fourfold size`. Level k cuts after each byte whose window hash
    falls into the lowest 1 / 2^k; a chunk's letter comes from the sum of its window hashes. The level is the least one, from
    4 below what the length suggests, with at most 64 chunks in fact, so a signature never leaves a chunk out. The whole
    text is hashed, in blocks of bounded size. A text in which all places have a few hashes may have a single chunk; one that
    has over 64 chunks even at the last level (a window of tiny hash, repeated) counts as a single chunk there."""
    least = max(LEAST_LEVEL, (max(1, len(text) - 1) // SIGNATURE).bit_length() - 4)
    marks, values, sums, before = [], [], [], np.uint32(0)
    for begin in range(0, len(text), BLOCK_BYTES):
        lead = min(begin, WINDOW - 1)
        h = window_hashes(np.frombuffer(text, np.uint8, min(BLOCK_BYTES, len(text) - begin) + lead, begin - lead))[lead:]
        at = np.nonzero(h < np.uint32(1 << (32 - least)))[0]
        running = np.cumsum(h, dtype=np.uint32) + before
        marks.append(at + begin)
        values.append(h[at])
        sums.append(running[at])
        before = running[-1]
    at, value, total = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (marks, values, sums))

    def ends(k: int) -> np.ndarray:
        chosen = value < np.uint32(1 << (32 - k))
        found = total[chosen]
        return np.append(found, before) if len(text) and not (chosen.any() and at[chosen][-1] == len(text) - 1) else found

    def signature(k: int) -> str:
        at_ends = ends(k)
        pieces = np.diff(at_ends if len(at_ends) <= SIGNATURE else at_ends[-1:], prepend=np.uint32(0)).astype(np.uint32) * np.uint32(0x9E3779B1)
        return "".join(map(LETTERS.__getitem__, (pieces >> np.uint32(26)).tolist()))

    level = least
    while level < LAST_LEVEL and len(ends(level)) > SIGNATURE:
        level += 1
    return ":".join([str(level), *(signature(level + k) for k in range(SIZES))])


def edit_distance(a: str, b: str) -> int:
    """Least number of letters put in or taken out (a change counts two), by bit-parallel longest common subsequence."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        common = row & places.get(c, 0)
        row = ((row + common) | (row - common)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def similar(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    run = max(3, min(7, min(len(a), len(b)) // 4))
    if {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint([b[k : k + run] for k in range(len(b) - run + 1)]):
        return 0.0  # chance matches of single letters don't count
    return 1 - edit_distance(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, else the best likeness of two signatures of one chunk size; 0 if they have no chunk
    size in common."""
    if a == b:
        return 1.0
    (ka, *of_a), (kb, *of_b) = a.split(":"), b.split(":")
    gap = int(kb) - int(ka)
    return max((similar(of_a[k + gap], of_b[k]) for k in range(SIZES) if 0 <= k + gap < SIZES), default=0.0)


def with_next(docs: DataFrame, cells_per_task: int = 8) -> DataFrame:
    """Rows (cell, extra, doc_id, text), dealt so that a cell's rows are together in order of descending doc_id.

    Cells are ranges of ids at quantiles, several a task, so the driver sees a few numbers a task and no text. Each
    cell ends with an extra copy of the first document of the cell after it (after the last cell: of the first).
    Null ids come last. Equal ids are ordered by their texts.
    """
    spark = docs.sparkSession
    n = cells_per_task * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    cuts = np.array(ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n)).first()[0] or [0], np.int64)
    cuts = np.unique(cuts)

    @F.arrow_udf(IntegerType())
    def cell_of(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, x.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    firsts = {r[0]: r[1] for r in ids.groupBy(cell_of("id").alias("cell")).agg(F.max("id")).collect()}  # a number a cell
    used = sorted(firsts)
    also: dict[int, list[int]] = {}
    for k, cell in enumerate(used):
        also.setdefault(firsts[cell], []).append(used[(k + 1) % len(used)])
    keys = np.array(sorted(also), np.int64)
    more = [also[k] for k in keys.tolist()]

    @F.arrow_udf(ArrayType(IntegerType()))
    def cells_of(x: pa.Array) -> pa.Array:
        x = x.to_numpy(zero_copy_only=False)
        own, at = np.searchsorted(cuts, x, side="left").tolist(), np.searchsorted(keys, x)
        found = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == x) if len(keys) else np.zeros(len(x), bool)
        return pa.array([[c, *more[k]] if f else [c] for c, k, f in zip(own, at.tolist(), found.tolist(), strict=True)], pa.list_(pa.int32()))

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("cells", cells_of(F.coalesce("doc_id", F.lit(-(1 << 63)))))
    rows = rows.select(F.posexplode("cells").alias("extra", "cell"), "doc_id", "text")
    rows = rows.select("cell", (F.col("extra") > 0).alias("extra"), "doc_id", "text")
    return rows.repartition(n // cells_per_task, "cell").sortWithinPartitions("cell", "extra", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its fingerprint, that of its text edited with the next document's, and likenesses.

    Next is the following row by descending doc_id (null ids last, equal ids by text); after the last comes the first.
    Null texts count as empty; an empty text has the fingerprint `2:::`. Two equal fingerprints have likeness 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, out = None, []
        for b in batches:
            for cell, extra, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fp = fingerprint(text.encode())
                if wait and wait[0] == cell:
                    _, _, own_doc, own, own_fp = wait
                    half = len(own) // 2
                    edited = (own[: len(own) - half] + text[:half]).encode()
                    edited_fp = own_fp if half == 0 else fingerprint(edited)
                    out.append((own_doc, len(own), hashlib.sha256(edited).hexdigest(), own_fp, edited_fp, likeness(own_fp, edited_fp), likeness(own_fp, fp)))
                wait = None if extra else (cell, extra, doc, text, fp)
            if len(out) >= 1000:
                yield batch(out)
                out = []
        yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op9_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all rows of documents; see there for nulls, ties, repeats and long texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
