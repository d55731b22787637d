"""The entry point, and every SQL-expressible query of the engine against DuckDB at the smallest size."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from ragloom.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"



@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    clean = lambda rows: sorted(repr([None if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r]) for r in rows)
    assert clean(got) == clean(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training_data(tmp_path):
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    code = "import sys; sys.modules['ragloom.llm.queries'] = None; sys.modules['ragloom.llm'] = None\nimport __spark_entry__ as e; print(len(e.queries()))"
    # None in sys.modules raises ModuleNotFoundError, as a deleted folder does
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) == len(QUERIES)
