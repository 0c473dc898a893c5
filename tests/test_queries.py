"""Every registered query of the library against its SQL, on the smallest data set."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark import plans


@pytest.fixture(scope="module")
def duck(sf):
    held = duckdb.connect()
    for name in os.listdir(sf):
        held.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return held


def canonical(frame):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return ""
        try:
            return f"{float(x):.6g}" if not isinstance(x, (str, bool)) else str(x)
        except (TypeError, ValueError):
            return str(x)

    return sorted([tuple(map(value, row)) for row in frame[sorted(frame.columns)].itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0
