import pytest
from conftest import DATA, same

from weftline.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    same(spark, duck, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


def test_entry_without_llm(tmp_path):
    """Without the subpackage and the pipeline the entry still imports."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip().endswith("False"), out.stderr


def test_filters_reach_the_scan(spark):
    plan = QUERIES["q_resource_totals"](spark, DATA)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
