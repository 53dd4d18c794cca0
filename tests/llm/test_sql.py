"""Registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from test_contracts import ODD_PII

from wellspring.llm import pii, queries


def same(got, want):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v) if isinstance(v, float) and v.is_integer() else v)
    key = lambda df: sorted((tuple(map(plain, r)) for r in df[cols].itertuples(index=False)))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(name, spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    same(queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLES[name]).df())


def test_personal_data_on_odd_texts(spark):
    more = ["IBAN DE89 3704 0044 0532 0130 00 ok", "DE89 3704 0044 0532 0130 01", "ssn 123-45-6789", "part no 123-45-6789, 000-12-3456", "Amex card 378282246310005", "order 378282246310005", "konto: GB82WEST12345698765432. 😀 visa 4222222222222"]
    documents = pd.DataFrame({"doc_id": range(len(ODD_PII) + len(more)), "text": [*ODD_PII, *more]})
    got = pii.digest(pii.personal_data(spark.createDataFrame(documents))).toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    same(got, con.sql(queries.ORACLES["op2_pii"]).df())
