"""The driver's contract: every query runs over whole tables and agrees with its SQL."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
NAMES = sorted(n for n in entry.queries() if n.startswith("q_"))


@pytest.fixture(scope="module")
def db(sf_dir_module):
    c = duckdb.connect()
    for p in Path(sf_dir_module).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def sf_dir_module():
    from .conftest import SF

    return SF


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, sf_dir_module, name):
    got = entry.queries()[name](spark, sf_dir_module).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = db.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_llm_part(tmp_path):
    """The rest imports and registers its queries where the subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "textloom" / "llm" / "__pycache__").mkdir(parents=True)  # as a deletion may leave it
    code = """
import __spark_entry__ as e
from textloom.session import local_session
assert e.queries() and e.oracle_sql() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
spark = local_session(2, 2, "1g")
assert e.entry(spark).count() and e.queries()["q_corpus_size"](spark, "/root/testdata/sf0.001").count()
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, env=os.environ | {"PYTHONPATH": str(tmp_path)})
