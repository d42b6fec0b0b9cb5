"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sigmill import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    rows = df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)
    plain = lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) else v
    return sorted(repr(tuple(map(plain, r))) for r in rows)


def test_queries_equal_their_sql(spark, duck):
    every, sql = queries.queries(), queries.oracle_sql()
    for name, query in every.items():
        got = query(spark, SF).toPandas()
        assert len(got), name
        if name in sql:
            want = duck.execute(sql[name]).df()
            assert sorted(got.columns) == sorted(want.columns), name
            assert canonical(got) == canonical(want), name


def test_entry_runs_without_the_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
