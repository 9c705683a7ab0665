"""The driver's three functions."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
OWN = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return out


def plain(value):
    return round(value, 9) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tallyloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "tallyloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyloom.llm" not in path.read_text()
