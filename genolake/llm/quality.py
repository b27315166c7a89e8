"""Operator 10: quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from genolake.llm.common import bucket, free_name, small_batches, table, with_result
from genolake.llm.fitting import bounded_sample, fitted

BINS = 1 << 18
ORDERS = (1, 2, 3, 4)
DOCS_PER_GRADE = 1500
STEPS = 200
RIDGE = 1e-4
BLOCK = 1 << 20


def hashed(data: bytes) -> Iterator[np.ndarray]:
    """Bins of the byte n-grams of a text, in blocks of bounded size (n-grams over a border count once)."""
    lead = max(ORDERS) - 1
    for begin in range(0, len(data), BLOCK):
        x = np.frombuffer(data[begin : begin + BLOCK + lead], np.uint8).astype(np.uint32)
        h = np.zeros(len(x), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = (h[: len(x) - n + 1] + x[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            yield ((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 18))[:BLOCK]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bins, shares): the counts of the n-grams' bins over the whole text, scaled to length 10 at any size of text."""
    if len(text) <= BLOCK:
        made = list(hashed(text))
        bins, counts = np.unique(np.concatenate(made), return_counts=True) if made else (np.zeros(0, np.int64), np.zeros(0))
    else:
        dense = np.zeros(BINS, np.int64)
        for h in hashed(text):
            dense += np.bincount(h, minlength=BINS)
        bins = np.nonzero(dense)[0]
        counts = dense[bins]
    counts = counts.astype(float)
    return bins.astype(np.int64), 10 * counts / max(1e-9, float(np.sqrt((counts**2).sum())))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[dict]) -> bytes:
    """Weights shared by all grades, and ordered thresholds between neighbouring grades, by gradient steps (Adam).

    P(grade > j) = sigmoid(w.x - t_j). Thresholds are a first one plus exponentials, so they stay in order. Grades
    count alike whatever their share in the sample.
    """
    grades = sorted({r["grade"] for r in rows})
    if len(grades) < 2:
        return pickle.dumps((grades, np.zeros(BINS, np.float32), np.zeros(0)))
    y = np.array([grades.index(r["grade"]) for r in rows])
    made = [features((r["text"] or "").encode("utf-8", "replace")) for r in rows]
    sizes = np.array([len(b) for b, _ in made])
    row, bins, values = np.repeat(np.arange(len(rows)), sizes), np.concatenate([b for b, _ in made]), np.concatenate([v for _, v in made])
    weight = (len(rows) / len(grades) / np.bincount(y, minlength=len(grades)))[y] / len(rows)
    w, free = np.zeros(BINS), np.zeros(len(grades) - 1)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, free)]
    for step in range(1, STEPS + 1):
        steps = np.concatenate(([free[0]], np.exp(free[1:])))
        cuts = np.cumsum(steps)
        z = np.bincount(row, w[bins] * values, len(rows))
        above = sigmoid(z[:, None] - cuts)  # P(grade > j)
        full = np.hstack([np.ones((len(y), 1)), above, np.zeros((len(y), 1))])
        at = np.arange(len(y))
        p = np.maximum(full[at, y] - full[at, y + 1], 1e-9)
        slope = np.hstack([np.zeros((len(y), 1)), above * (1 - above), np.zeros((len(y), 1))])
        dz = -weight * (slope[at, y] - slope[at, y + 1]) / p
        dcut = np.zeros(len(cuts) + 2)
        np.add.at(dcut, y, weight * slope[at, y] / p)
        np.add.at(dcut, y + 1, -weight * slope[at, y + 1] / p)
        tail = np.cumsum(dcut[1:-1][::-1])[::-1]
        grad = [np.bincount(bins, dz[row] * values, BINS) + RIDGE * w, tail * np.concatenate(([1.0], steps[1:]))]
        for param, g, (m, v) in zip((w, free), grad, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            param -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cuts = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
    return pickle.dumps((grades, w.astype(np.float32), cuts))


def learn(docs: DataFrame, ratings: DataFrame, most: int = DOCS_PER_GRADE) -> bytes:
    """Fits on at most about `most` documents of each grade; ratings: (doc_id, grade), null grades left out; of several grades
    of one document the highest counts."""
    rows = docs.select("doc_id", "text").join(ratings.where("grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade")), "doc_id")
    return fitted(bounded_sample(rows, most, ["grade"]), fit)


def graded(texts: list[bytes | None], model: tuple, least: int) -> tuple[pa.Array, pa.Array]:
    """(expected grade, probability of grade `least` or more) of each text."""
    grades, w, cuts = model
    z = np.zeros(len(texts))
    for k, text in enumerate(texts):
        bins, values = features(text or b"")
        z[k] = float(w[bins] @ values)
    if len(grades) < 2:
        same = grades[0] if grades else None
        return pa.array([same] * len(z), pa.float64()), pa.array([float(same is not None and same >= least)] * len(z), pa.float64())
    above = sigmoid(z[:, None] - cuts)
    j = int(np.searchsorted(grades, least))
    tail = np.ones(len(z)) if j == 0 else np.zeros(len(z)) if j == len(grades) else above[:, j - 1]
    return pa.array(grades[0] + above @ np.diff(np.array(grades, float))), pa.array(tail, pa.float64())


def grade(docs: DataFrame, model: bytes, least: int = 1) -> DataFrame:
    """docs' doc_id with expected_grade and tail (probability of grade `least` or more), for every row.

    Null and empty texts have no n-gram and get what the thresholds alone give. With a model that saw under two grades
    expected_grade is that grade (or null) and tail 1 if it is at least `least`, else 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            expected, tail = graded(b.column(1).to_pylist(), pickle.loads(shared.value), least)
            yield pa.RecordBatch.from_arrays([b.column(0), expected, tail], ["doc_id", "expected_grade", "tail"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, expected_grade double, tail double")


KEEP_TAIL = 0.3


def accepted(docs: DataFrame, model: bytes, least: int = 1, tail: float = KEEP_TAIL) -> DataFrame:
    """The rows of docs with a probability of at least `tail` for grade `least` or more; all columns stay.

    A model that saw under two grades can't tell, so then every row is kept. Repeated rows stay.
    """
    if len(pickle.loads(model)[0]) < 2:
        return docs
    name = free_name(docs, "grade_tail")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = pickle.loads(shared.value)
        return lambda texts: graded([None if t is None else t.encode("utf-8", "replace") for t in texts], known, least)[1]

    return with_result(docs, name, DoubleType(), make).where(F.col(name) >= tail).drop(name)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades 0 to 2 from the label table: poor, good but toxic, good."""
    return labels.where("quality is not null").select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail, kept) of every row of documents. Fitted on rows whose crc32(doc_id as text)
    mod 4 is not 3; the others are held out. Null and empty texts get the grade of the thresholds alone; equal texts get
    equal grades; rows with a null doc_id are graded too and never fitted on."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(bucket("doc_id", 4) == 3, F.lit(False))
    model = learn(docs.where(~held), ratings(table(spark, sf_dir, "labels")))
    out = grade(docs, model).withColumn("kept", F.col("tail") >= KEEP_TAIL)
    return out.select("doc_id", held.alias("held_out"), "expected_grade", "tail", "kept")
