"""A few queries with code generation as it is by default, which the other tests do without; in a process of its own."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys
sys.path.insert(0, {root!r})
import duckdb
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
c = duckdb.connect()
c.sql("SET timezone = 'UTC'")
for t in ("events", "graph_edges", "replica_edges", "execute_operations", "graph_metadata"):
    c.sql(f"CREATE VIEW {{t}} AS FROM '{sf}/{{t}}.parquet'")
row = lambda t: sorted(str(sorted(r.items())) for r in t.to_pylist())
for name in ("batched_mixed", "page_ties", "page_key_zero_one", "p4_found", "p5_found", "p6_found"):
    assert row(e.queries()[name](spark, {sf!r}).toArrow()) == row(c.sql(e.oracle_sql()[name]).to_arrow_table()), name
print("all equal")
"""


def test_queries_with_code_generation():
    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test tables here")
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, sf=sf)], capture_output=True, text=True, timeout=600)
    assert "all equal" in done.stdout, done.stderr[-2000:]
