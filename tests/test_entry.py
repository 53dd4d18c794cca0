"""Registered queries against their SQL in DuckDB, and the entry module without the optional parts."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from wellspring.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, np.integer)):
            return int(v)
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)

    df = df[sorted(df.columns)]
    return sorted((tuple(one(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(name, spark, sf, duck):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if got.dtypes.eq("object").any() or len(got):
        for a, b in zip(rows(got), rows(want), strict=True):
            assert all(x == y or (isinstance(x, float) and y is not None and abs(x - y) < 2e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["principal_lineages", "find_outlier_objects", "extract_features", "analyse_screen", "check_labels"])
def test_queries_without_sql_run(name, spark, sf):
    assert name not in catalogue.ORACLES and catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, check=True)
