"""Cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of these tables. A task holds one of each file that it reads or writes, so this, and not the table, tells
#: its memory.
ROW_GROUP = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session in local mode, where the driver is the
    executor, may do without: it gets a temporary folder. On a cluster a missing setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> None:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: loops keep short plans, and a lost executor costs no
    earlier round."""
    path = new_folder(df.sparkSession, "lineage")
    save(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
