"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tessera.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(frame, columns):
    text = frame[columns].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan", "-0.0": "0.0"})
    return sorted(map(tuple, text.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    expected = duck.sql(ORACLES[name]).to_arrow_table().to_pandas()
    got = QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(expected.columns)
    assert rows(got, columns) == rows(expected, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_queries_have_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
