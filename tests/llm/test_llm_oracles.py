"""The training-data queries against their SQL in DuckDB."""

import duckdb
import pytest
from test_oracles import SF, TABLES, same_rows

from skyfix.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same_rows(queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).fetchdf())
