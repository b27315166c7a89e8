"""All distances of sequences and nodes: what is sent to the groups, and array steps inside a group."""

import random

import pyarrow as pa
import pyarrow.compute as pc

from genolake.operators import placement, tree


def tables(spark, n_seq, n_node):
    rng = random.Random(5)
    muts = lambda n, name: spark.createDataFrame([(i, "nuc", p, rng.choice("ACGT")) for i in range(n) for p in rng.sample(range(60), 3)], f"{name} long, cds string, pos int, qry string")
    ranges = lambda size: spark.createDataFrame([(i, i % 40, i % 40 + size) for i in range(n_seq)], "seq_index long, begin int, end int")
    spans = spark.createDataFrame([(i, 0, 60) for i in range(n_seq)], "seq_index long, begin int, end int")
    return muts(n_seq, "seq_index"), spans, ranges(2), ranges(1), muts(n_node, "node_id"), spark.createDataFrame([(10, 14)], "begin int, end int"), 60


def test_a_sequence_is_sent_once_for_many_nodes(spark, monkeypatch):
    def sent(schema):
        def run(batches):
            rows = pa.Table.from_batches(list(batches))
            nodes = pc.sum(rows["is_node"]).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows - nodes]), pa.array([nodes]), pa.array([1])], schema=schema)

        run.__annotations__ = placement.distances_in(schema).__annotations__
        run.__globals__.update(Iterator=placement.Iterator)
        return run

    monkeypatch.setattr(tree, "distances_in", sent)
    groups = tree.placement_distance(*tables(spark, 3000, 2500)).collect()
    assert sum(g.seq_index for g in groups) == 3000
    assert sum(g.node_id for g in groups) == 2500 * len(groups) <= 2500 * 2


def test_array_steps_of_a_group(spark, monkeypatch):
    args = tables(spark, 50, 30)
    whole = sorted(map(tuple, tree.placement_distance(*args).collect()))
    monkeypatch.setattr(placement, "PROFILES", 7)
    monkeypatch.setattr(placement, "STEP", 4)
    assert sorted(map(tuple, tree.placement_distance(*args).collect())) == whole
    assert len({(i, k) for i, k, _ in whole}) == len(whole) > 300
