"""Every query of the engine's own against its SQL counterpart in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from skyfix import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES, SQL = dict(plans.QUERIES), dict(plans.ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def _rows(df, columns):
    return sorted((tuple(map(_value, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)


def same_rows(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(spark, duck, name):
    got = NAMES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    same_rows(got, duck.execute(SQL[name]).fetchdf())
