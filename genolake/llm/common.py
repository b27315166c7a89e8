"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from genolake.plans.scratch import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table which no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucket(column: str, n: int, seed: str = "") -> F.Column:
    """crc32 of the id as text, modulo n: the split into training and held-out rows."""
    return F.crc32(F.concat(F.col(column).cast("string"), F.lit(seed)).cast("binary")) % n


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bounds the rows and bytes that a Python worker gets at once, as texts may be very long. These are settings of the
    session that change no result; a query's plan takes them up when it runs, so they aren't set back here."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_chunks(texts: list[str | bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes (or letters) together, at least one row each."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t or "") + 8
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b: long) by alternating large-star and small-star steps, until none changes an edge.

    Returns (node, root) for every node of an edge; root is the least node of its component. The number of rounds
    grows with the logarithm of the component size. Minima are pre-aggregated before each shuffle, so a hub costs
    one row a task; the joins back are plain equi-joins that adaptive execution may split. Null ends are ignored.
    """
    e = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges0"
    )
    before = None
    for k in count(1):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("p"))
        e = scratch.save(small.select("p.b", "p.m").toDF("a", "b").where("a <> b").distinct(), f"edges{k}")
        if k > 1:
            scratch.drop(f"edges{k - 2}")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until no column of df has it (names are compared without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_result(docs: DataFrame, name: str, kind: DataType, make: Callable[[], Callable[[list[str | None]], pa.Array]]) -> DataFrame:
    """docs with one more column, computed from the column text batch by batch where the rows are read: no shuffle.

    make() is called once in each task. name must be free (see free_name).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for b in batches:
            yield b.append_column(name, compute(b.column(at).to_pylist()))

    at = docs.columns.index("text")
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, kind)]))
