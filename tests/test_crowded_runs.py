"""Queries against their SQL on runs of over a thousand keyframes, many at one time."""

import os

import duckdb
import pytest

from tidemark import plans

from test_queries import canonical


@pytest.fixture(scope="module")
def crowded(sf, tmp_path_factory):
    """The smallest data set with its events thirty times over in five runs."""
    at, held = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for name in os.listdir(sf):
        (at / name).symlink_to(f"{sf}/{name}") if name != "events.parquet" else None
    held.execute(f"COPY (SELECT event_id + 100000 * i AS event_id, ts, user_id % 5 AS user_id, event_type, value, props FROM '{sf}/events.parquet', range(30) r(i)) TO '{at}/events.parquet'")
    for name in os.listdir(at):
        held.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{at}/{name}')")
    return str(at), held


@pytest.mark.parametrize("name", ["keyframe_select", "selection_summary", "collapse_summary", "collapse_groups"])
def test_query_agrees_with_sql_on_crowded_runs(spark, crowded, name):
    at, held = crowded
    got, want = plans.QUERIES[name](spark, at).toPandas(), held.execute(plans.ORACLE_SQL[name]).df()
    assert canonical(got) == canonical(want)
