"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from basalt.llm import queries
from tests.conftest import SF
from tests.test_parity import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(queries.QUERIES[name](spark, SF).toPandas()), plain(c.sql(queries.ORACLES[name]).df()))
