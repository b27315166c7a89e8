"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolake.plans.scratch import cut_lineage


def numbered(df: DataFrame, name: str, groups: list[str] | None = None) -> DataFrame:
    """df with a number from 0 in `name`, in the order of its partitions and of the rows in them (so after orderBy: in that
    order). With `groups`, columns whose equal values stand together in one partition, groups follow their own order instead.

    The table is written once; what meets in one task is one row a partition (or group): its size, from which its first
    number follows. Rows never leave their partition.
    """
    spark_id = F.monotonically_increasing_id()
    saved = cut_lineage(df.withColumn("_id", spark_id))
    keys = groups or ["_part"]
    saved = saved.withColumn("_part", F.shiftright("_id", 33))
    sizes = saved.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "_first", before.alias("_before"))
    return saved.join(starts, keys).withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop("_id", "_part", "_n", "_first", "_before")
