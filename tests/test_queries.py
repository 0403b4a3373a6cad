"""Every query that has SQL against DuckDB on the smallest tables, in one pass; and what must hold of the registry."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from brickfield.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_without_the_text_operators(tmp_path):
    code = "import sys; sys.path.insert(0, %r); import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if 'llm' in n or n == 'corpus_pipeline' else f(n, *a); import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any('llm' in m for m in sys.modules))"
    root = entry.__file__.rsplit("/", 1)[0]
    out = subprocess.run([sys.executable, "-c", code % root], capture_output=True, text=True, cwd=tmp_path)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), "False"], out.stderr


@pytest.mark.parametrize("pipeline", [True, False])
def test_registry_in_a_copy_without_the_folders(tmp_path, pipeline):
    """The other queries are there and run where the text operators' folders are gone, with their pipeline or without."""
    root, copy = os.path.dirname(os.path.abspath(entry.__file__)), tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    code = (
        "import __spark_entry__ as e; from pyspark.sql import SparkSession; assert e.__file__.startswith(%r), e.__file__; "
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        "print(len(e.queries()), len(e.oracle_sql()), e.queries()['roi_crop'](s, %r).count())"
    )
    out = subprocess.run([sys.executable, "-c", code % (str(copy), SF)], capture_output=True, text=True, cwd=copy)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL)), str(500 * 18)], out.stderr
