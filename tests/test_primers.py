"""Primers without number: blocks of primers against the plain join."""

from collections import Counter

import pytest

from genolake.operators import qc


def test_many_primers(spark, monkeypatch):
    monkeypatch.setattr(qc, "SEQUENCES", 7)
    monkeypatch.setattr(qc, "PRIMERS", 5)
    subs = [(i if i % 11 else None, p, "A", "CGT"[(i + p) % 3] if i % 13 else None) for i in range(60) for p in range(i % 4, 40, 6)]
    primers = [(f"p{k}" if k % 9 else None, k % 35, k % 35 + 3) for k in range(80)] + [("p1", 1, 4), ("none", None, 5)]
    letters = [(f"p{k}", k % 35 + 1, "AG") for k in range(80)] + [("p2", 3, "C")]
    tables = spark.createDataFrame(subs, "seq_index long, pos int, ref string, qry string"), spark.createDataFrame(primers, "name string, begin int, end int"), spark.createDataFrame(letters, "name string, pos int, letters string")
    plain, many = qc.primer_changes(*tables), qc.many_primer_changes(*tables)
    assert many.columns == plain.columns
    assert Counter(map(tuple, many.collect())) == Counter(map(tuple, plain.collect()))


@pytest.mark.parametrize("name", ["c8_primer_changes"])
def test_rows_are_made_by_all_tasks(spark, tmp_path, name):
    """The join by 300 places was read by the few tasks that adaptive execution left of a small shuffle."""
    from genolake.queries import QUERIES

    spark.range(400).selectExpr("id l_orderkey", "id * 7 l_partkey", "cast(id % 50 as double) l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(500).selectExpr("id p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.where("name is not null").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
