"""What a task holds does not grow with the table."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from genolake.operators import placement
from genolake.operators.tour import euler_tour
from genolake.plans import scratch


def test_row_groups_are_small(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROW_GROUP", 1 << 20)
    df = scratch.cut_lineage(spark.range(0, 600_000, 1, 1).select(F.xxhash64("id").alias("x")))
    assert df.count() == 600_000
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert len(sizes) > 2
    assert max(sizes) < 1 << 22


def test_a_task_of_the_search_has_few_groups(spark, monkeypatch):
    monkeypatch.setattr(placement, "PROFILES", 1)
    monkeypatch.setattr(placement, "GROUPS", 1)
    asked, frames = [], type(spark.range(1))
    old = frames.repartition
    monkeypatch.setattr(frames, "repartition", lambda self, n, *c: asked.append(n) or old(self, n, *c))
    nodes = spark.createDataFrame([(1, None, 1, "a", None), (2, 1, 2, "a", None), (3, 1, 3, "b", None)], "node_id long, parent_id long, preorder int, clade string, prior double")
    states = spark.createDataFrame([(2, "nuc", 5, "C"), (3, "nuc", 7, "G")], "node_id long, cds string, pos int, qry string")
    subs = spark.createDataFrame([(i, "nuc", 5 + 2 * (i % 2), "ACGT"[i // 2 % 4]) for i in range(400)] + [(i, "nuc", 7 - 2 * (i % 2), "ACGT"[i // 8 % 4]) for i in range(400)], "seq_index long, cds string, pos int, qry string")
    seqs = spark.range(400).withColumnRenamed("id", "seq_index")
    spans, none = seqs.select("seq_index", F.lit(0).alias("begin"), F.lit(20).alias("end")), spark.createDataFrame([], "seq_index long, begin int, end int")
    near = placement.place(seqs, subs, spans, none, none, nodes, euler_tour(nodes), states, spark.createDataFrame([(18, 19)], "begin int, end int"), 20)
    assert near.count() == 400
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    profiles = near.join(subs, "seq_index").groupBy("seq_index").agg(F.array_sort(F.collect_list(F.concat(F.col("pos"), "qry"))).alias("x")).select("x").distinct().count()
    assert max(asked) == profiles > parts
