"""Every registered query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import catalog


def canonical(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)):
            return float(f"{v:.9g}")
        return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(cell(v) for v in row)) for row in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.SQL.keys()))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
