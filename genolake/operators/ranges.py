"""Points to ranges, and points in ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(points: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """(keys, begin, end): maximal runs of consecutive positions. One sort by the keys and pos; repeated points count once."""
    w = Window.partitionBy(*keys).orderBy(pos)
    run = points.select(*keys, pos).distinct().withColumn("_run", F.col(pos) - F.row_number().over(w))
    out = run.groupBy(*keys, "_run").agg(F.min(pos).alias("begin"), (F.max(pos) + 1).alias("end"))
    return out.drop("_run")


def group_adjacent(points: DataFrame, keys: list[str]) -> DataFrame:
    """Deleted points of each key as ranges."""
    return islands(points, keys)


def with_open_ends(points: DataFrame, kinds: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(row, open): row holds the columns of a point; open[k] is the farthest end of the ranges of kind k and the point's keys
    that begin at or before it, null without any. A sweep: points and ranges in one sort by keys and place, the ends carried forward,
    so a point is not met with each range of its keys. Null keys, places and ends belong to nothing."""
    place = lambda c: F.col(c).cast("long").alias("_at")
    tables = [points.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], place("pos"), F.lit(None).cast("string").alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("row"))]
    for kind, r in kinds.items():
        known = r.dropna(subset=[*keys, "begin", "end"])
        tables.append(known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], place("begin"), F.lit(kind).alias("_kind"), F.col("end").cast("long").alias("_end"), F.lit(None).alias("row")))
    both = reduce(DataFrame.union, tables)
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_at", F.col("_kind").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.struct(*[F.max(F.when(F.col("_kind") == k, F.col("_end"))).over(w).alias(k) for k in kinds])
    return both.select("row", "_kind", ends.alias("open")).where("_kind is null").drop("_kind")


def in_range(points: DataFrame, ranges: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """Points within (left_semi) or outside (left_anti) the ranges of the same keys. With no keys, ranges must be a small
    table (masks): Spark then broadcasts it."""
    if keys:
        within = F.coalesce(F.col("open.r") > F.col("row.pos"), F.lit(False))
        return with_open_ends(points, {"r": ranges}, keys).where(within if how == "left_semi" else ~within).select("row.*")
    r = ranges.select(F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    return points.join(r, (F.col("pos") >= F.col("_begin")) & (F.col("pos") < F.col("_end")), how)


def is_sequenced(points: DataFrame, aligned: DataFrame, missing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Points inside the aligned range of their sequence and in none of its missing ranges, in one sweep."""
    swept = with_open_ends(points, {"aligned": aligned, "missing": missing}, keys or ["seq_index"])
    at = F.col("row.pos")
    return swept.where((F.col("open.aligned") > at) & ~F.coalesce(F.col("open.missing") > at, F.lit(False))).select("row.*")
