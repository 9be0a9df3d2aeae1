"""Every registered raster query against its SQL, on the smallest tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from emulsa.plans import catalogue

SQL = catalogue.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)].round(5).astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("embeddings", "documents", "events", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf, duck):
    df = catalogue.queries()[name](spark, sf)
    got, want = df.toPandas(), duck.execute(SQL[name]).df()
    if re.search("FlatMap|MapIn", df._jdf.queryExecution().analyzed().toString()):  # what runs Python sees other columns under an aggregate
        assert df.count() == len(got)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_runs(name, spark, sf):
    df = catalogue.queries()[name](spark, sf)
    assert df.groupBy(df.columns[0]).agg(F.count("*").alias("n")).agg(F.sum("n")).first()[0] > 0
