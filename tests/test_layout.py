"""Sweeps over ranges, and sinks laid out by size."""

import random
from collections import Counter
from pathlib import Path

import pytest

from genolake.operators import ranges
from genolake.sources import fasta


@pytest.mark.parametrize("seed", [1, 2])
def test_sweep_matches_each_point_with_each_range(spark, seed):
    rnd = random.Random(seed)
    points = [(rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y"]), rnd.choice([*range(30), None]), f"t{i % 90}") for i in range(300)]
    spans = lambda n: [(rnd.choice([1, 2, 3, None]), rnd.choice(["x", "y"]), b, b + rnd.randint(0, 8)) for b in (rnd.randrange(30) for _ in range(n))]
    first, second = spans(12), [*spans(6), (1, "x", None, 9), (2, "y", 3, None)]
    p = spark.createDataFrame(points, "seq_index long, cds string, pos int, `row` string").repartition(3)
    a, b = (spark.createDataFrame(x, "seq_index long, cds string, begin int, end int") for x in (first, second))
    inside = lambda q, of: None not in (q[0], q[2]) and any(r[:2] == q[:2] and None not in r and r[2] <= q[2] < r[3] for r in of)
    keys, got = ["seq_index", "cds"], lambda df: Counter(map(tuple, df.collect()))
    assert got(ranges.in_range(p, a, keys)) == Counter(q for q in points if inside(q, first))
    assert got(ranges.in_range(p, a, keys, "left_anti")) == Counter(q for q in points if not inside(q, first))
    sequenced = ranges.is_sequenced(p, a, b, keys)
    assert sequenced.schema == p.schema and got(sequenced) == Counter(q for q in points if inside(q, first) and not inside(q, second))
    assert "Join" not in sequenced._jdf.queryExecution().executedPlan().toString()
    assert ranges.is_sequenced(p.limit(0), a, b, keys).isEmpty() and ranges.is_sequenced(p, a.limit(0), b, keys).isEmpty()


def test_sinks_have_files_by_size(spark, tmp_path):
    n, target = 3_000, 20_000
    seqs = spark.range(n).selectExpr("id seq_index", "concat('s', id) seq_name", "repeat('ACGT', 5) seq")
    hits = spark.range(n).selectExpr("id seq_index", "case when id < 2900 then 'a/hot' else 'b' end name")  # most are of one dataset
    fasta.split_output(seqs, hits, str(tmp_path / "out"), target)
    back = spark.read.text(str(tmp_path / "out"), lineSep="\n>")
    assert {r["dataset"]: r["count"] for r in back.groupBy("dataset").count().collect()} == {"a": 2900, "a/hot": 2900, "b": 100}
    for folder in (tmp_path / "out").glob("dataset=*"):
        sizes = [f.stat().st_size for f in Path(folder).glob("part-*")]
        assert len(sizes) == -(-sum(sizes) // target) and max(sizes) < 1.5 * target
    fasta.write_peptides(seqs.selectExpr("'S' cds", "seq_name", "seq aa").limit(0), str(tmp_path / "none"))
    fasta.write_peptides(seqs.selectExpr("'S' cds", "'same' seq_name", "seq aa").limit(10), str(tmp_path / "pep"))
    assert spark.read.text(str(tmp_path / "pep"), lineSep="\n>").count() == 10
