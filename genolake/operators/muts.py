"""Algebra of mutation lists, as joins on (key, cds, pos). Lists: key columns, cds, pos, ref, qry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = [*keys, "cds", "pos"]
    a = left.select(*on, F.col("ref").alias("l_ref"), F.col("qry").alias("l_qry"))
    b = right.select(*on, F.col("ref").alias("r_ref"), F.col("qry").alias("r_qry"))
    return a.join(b, on, how)


def split_muts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cds, pos, ref, qry, side): side is shared, left or right; `error` where the origin letters differ."""
    j = _both(left, right, keys, "full_outer")
    same = (F.col("l_ref") == F.col("r_ref")) & (F.col("l_qry") == F.col("r_qry"))
    rows = F.when(F.col("r_qry").isNull(), F.array(F.struct(F.col("l_ref").alias("ref"), F.col("l_qry").alias("qry"), F.lit("left").alias("side"))))
    rows = rows.when(F.col("l_qry").isNull(), F.array(F.struct(F.col("r_ref").alias("ref"), F.col("r_qry").alias("qry"), F.lit("right").alias("side"))))
    rows = rows.when(same, F.array(F.struct(F.col("l_ref").alias("ref"), F.col("l_qry").alias("qry"), F.lit("shared").alias("side"))))
    rows = rows.when(F.col("l_ref") != F.col("r_ref"), F.array(F.struct(F.col("l_ref").alias("ref"), F.col("l_qry").alias("qry"), F.lit("error").alias("side"))))
    rows = rows.otherwise(
        F.array(F.struct(F.col("l_ref").alias("ref"), F.col("l_qry").alias("qry"), F.lit("left").alias("side")), F.struct(F.col("r_ref").alias("ref"), F.col("r_qry").alias("qry"), F.lit("right").alias("side")))
    )
    return j.select(*keys, "cds", "pos", F.inline(rows))


def compose_muts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cds, pos, ref, qry, valid): right after left or left after right where both change a site (a change and its
    reversal stay as one row with equal letters); a site where neither follows the other is not valid."""
    j = _both(left, right, keys, "full_outer")
    one = F.col("r_qry").isNull() | F.col("l_qry").isNull()
    after, before = F.col("l_ref") == F.col("r_qry"), F.col("l_qry") == F.col("r_ref")
    ref = F.when(one, F.coalesce("l_ref", "r_ref")).when(after, F.col("r_ref")).otherwise(F.col("l_ref"))
    qry = F.when(one, F.coalesce("l_qry", "r_qry")).when(after, F.col("l_qry")).otherwise(F.col("r_qry"))
    return j.select(*keys, "cds", "pos", ref.alias("ref"), qry.alias("qry"), (one | after | before).alias("valid"))


def subtract_muts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """What takes the state after right to the state after left, at the sites of left."""
    j = _both(left, right, keys, "left")
    origin, target = F.col("l_ref") == F.col("r_ref"), F.col("l_qry") == F.col("r_qry")
    pair = lambda a, b: F.struct(F.col(a).alias("ref"), F.col(b).alias("qry"))
    new = F.when(F.col("r_qry").isNull(), pair("l_ref", "l_qry")).when(origin & ~target, pair("r_qry", "l_qry")).when(target & ~origin, pair("l_ref", "r_ref"))
    return j.select(*keys, "cds", "pos", new.alias("m")).where("m is not null").select(*keys, "cds", "pos", "m.ref", "m.qry")


def inverted(muts: DataFrame) -> DataFrame:
    return muts.withColumns({"ref": F.col("qry"), "qry": F.col("ref")})


def label_mutations(subs: DataFrame, labels: DataFrame) -> DataFrame:
    """subs with `labels` (array, null if none) of the first entry that fits in the order of its letter: nucleotide
    entries must name the letter, amino-acid entries without a letter fit any. labels: (cds, pos, qry, labels), small."""
    l = labels.select("cds", "pos", F.col("qry").alias("_q"), F.col("labels").alias("_l"))
    entries = l.groupBy("cds", "pos").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_q", F.lit("")).alias("q"), F.col("_l").alias("l")))).alias("_e"))
    fit = F.filter("_e", lambda e: (e["q"] == F.col("qry")) | ((e["q"] == "") & (F.col("cds") != "nuc")))
    return subs.join(entries, ["cds", "pos"], "left").withColumn("labels", F.try_element_at(fit, F.lit(1))["l"]).drop("_e")


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
