"""Queries that are the first of a session, where Spark plans them with other numbers of columns than later on."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

RUN = """
import sys
from pyspark.sql import SparkSession
name, folder = sys.argv[1:]
conf = {"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{folder}/checkpoints"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
import __spark_entry__ as driver
print("rows", len(driver.queries()[name](spark, folder).collect()))
"""


@pytest.mark.parametrize(("name", "rows"), [("t10_cds_coverage", 5), ("t8_group_aa_changes", 1)])
def test_first_query_of_a_session(tmp_path, name, rows):
    texts = ["a" * 40 + "k" + "a" * 300, "a" * 70]  # the second ends before the last gene
    rows_of = {"doc_id": pa.array([1, 2], pa.int64()), "text": texts, "lang": ["en"] * 2, "source": ["web"] * 2, "n_chars": pa.array([341, 70], pa.int64())}
    pq.write_table(pa.table(rows_of), tmp_path / "documents.parquet")  # all columns: the plan depends on their numbers
    done = subprocess.run([sys.executable, "-c", RUN, name, str(tmp_path)], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=300, check=False)
    assert f"rows {rows}" in done.stdout, done.stderr[-2000:]
