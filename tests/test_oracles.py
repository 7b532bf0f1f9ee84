"""Each registered query with a SQL twin equals DuckDB on the smallest fixture."""
import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, norm_frame

SF_SMALL = "/root/testdata/sf0.001"
NAMES = list(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    dp = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(dp.columns)
    assert norm_frame(sdf.toPandas()) == norm_frame(dp)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "hidden_gem_score" in df.columns
