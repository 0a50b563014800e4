import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_outside_llm_imports_it():
    for p in (ROOT / "adjset").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_queries_and_sql_name_each_other():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p2_found", "p4_found", "p5_found", "p6_found", "edge_fold", "nested_set_expr"} <= set(s)


def test_queries_match_their_sql_on_the_smallest_tables(spark):
    """A few queries of each kind against DuckDB; the driver compares all of them on larger tables."""
    import duckdb
    import pytest

    import __spark_entry__ as e

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in sf.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    for name in ("edge_fold", "page_backward", "union_paged", "replica_diff", "op_explode", "p2_found", "p4_found", "p5_found", "p6_found", "p6_by_month"):
        row = lambda t: sorted(str(sorted(r.items())) for r in t.to_pylist())
        assert row(e.queries()[name](spark, str(sf)).toArrow()) == row(c.sql(e.oracle_sql()[name]).to_arrow_table()), name


def test_the_flagship_query_has_rows(spark):
    import __spark_entry__ as e

    assert not e.entry(spark).isEmpty()
