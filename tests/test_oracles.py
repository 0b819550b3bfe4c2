"""The correctness gate at sf0.001: every query with an oracle equals DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from harrow.sources.tables import TABLES
from tests.conftest import SF_SMALL
from tools.check import rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.count() >= 0 and df.columns


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = queries()[name](spark, SF_SMALL)
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(ocols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(ocols, res.fetchall())
