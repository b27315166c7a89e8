"""What the trained operators share: a bounded sample for fitting, one fitting task, and a broadcast model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that a fitting task takes in at most, in bytes; rows are read in the order of their hashes until then.
MOST_BYTES = 256 << 20
DRAWS = 1 << 62


def draw(seed: str = "fit") -> Column:
    """0 .. 2^62-1, by the hash of doc_id."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), F.lit(DRAWS))


def below(most: int, n: int) -> int:
    """The draw below which about `most` of n rows lie; exact in whole numbers, whatever n."""
    return DRAWS if n <= most else DRAWS * most // n


def bounded_sample(rows: DataFrame, most: int, by: list[str] | None = None, seed: str = "fit") -> DataFrame:
    """About `most` rows (of each group in `by`): those whose hashed doc_id is below most / count of all hashes.

    Counts come first, so the sample's size is bounded whatever the table's. A group smaller than `most` is kept whole.
    The id only decides who is in the sample; it is no input of a model.
    """
    by = by or []
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if not by:
        return rows.where(draw(seed) < F.lit(below(most, counts.first()["_n"])))
    chosen = F.lit(False)
    for r in sorted(counts.collect(), key=str):  # one number a class
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.lit(r[c]))
        chosen = chosen | (same & (draw(seed) < F.lit(below(most, r["_n"]))))
    return rows.where(chosen)


def fitted(sample: DataFrame, fit: Callable[[list[dict]], bytes], most_bytes: int = MOST_BYTES) -> bytes:
    """fit() of a bounded sample, run in one task; the model comes back as bytes of a fixed size.

    Rows come in the order of their hashes, so neither their arrival nor the partitions matter. Reading ends with the
    row whose text exceeds `most_bytes`: very long texts must not exhaust the task.
    """
    names = sample.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                if size <= most_bytes:
                    rows.append({k: r[k] for k in names})
                    size += len(r["text"] or "")
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], ["model"])

    ordered = sample.withColumn("fit_order", draw("order")).repartition(1).sortWithinPartitions("fit_order", "doc_id", "text")
    found = ordered.mapInArrow(run, "model binary").first()
    return bytes(found["model"]) if found else fit([])  # Spark runs no task for an empty sample
