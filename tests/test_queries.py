"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF
from paperloom.plans.catalog import ORACLE_SQL, QUERIES
from paperloom.sources.tables import NAMES


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return f"{float(v):.6g}"
        return str(v)

    for c in df:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = normal(QUERIES[name](spark, SF).toPandas())
    if name in ORACLE_SQL:
        pd.testing.assert_frame_equal(got, normal(duck.execute(ORACLE_SQL[name]).df()), check_dtype=False, check_column_type=False)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["phrase", "lang", "docs"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
