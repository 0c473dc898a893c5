"""Collapse where a run has no keyframe, and where a fullness lies halfway between two roundings."""

import os
from itertools import product

import duckdb
import pytest

from tidemark import plans
from tidemark.operators import folds

from test_queries import canonical


@pytest.mark.parametrize("name", ["collapse_summary", "collapse_groups", "keyframe_select"])
def test_runs_without_a_keyframe_are_as_in_sql(spark, sf, tmp_path, name):
    held = duckdb.connect()
    for table in os.listdir(sf):
        (tmp_path / table).symlink_to(f"{sf}/{table}") if table != "events.parquet" else None
    # of run 0, only frames that are never accepted
    rows = f"SELECT event_id, ts, user_id, event_type, value, props FROM '{sf}/events.parquet' WHERE user_id > 0"
    also = f"SELECT 1700000 + 17 * event_id AS event_id, ts, 0 AS user_id, event_type, value, props FROM '{sf}/events.parquet' WHERE user_id = 1"
    held.execute(f"COPY ({rows} UNION ALL {also}) TO '{tmp_path}/events.parquet'")
    for table in os.listdir(tmp_path):
        held.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{tmp_path}/{table}')")
    got, want = plans.QUERIES[name](spark, str(tmp_path)).toPandas(), held.execute(plans.ORACLE_SQL[name]).df()
    assert len(want) and 0 not in set(want["run_id"])
    assert canonical(got) == canonical(want)


def test_fullness_rounds_as_sql():
    frames = [{"content": c / 64 * k / 10, "detail": round(d / 112, 6) * k / 10 * k / 10, "layout": n / 16 * k / 10} for c, d, n, k in product(range(0, 64, 3), range(0, 112, 7), range(0, 16, 3), range(10))]
    held = duckdb.connect()
    held.execute("CREATE TABLE f (i INTEGER, content DOUBLE, detail DOUBLE, layout DOUBLE)")
    columns = ", ".join(f"unnest(${c}) AS {c}" for c in ("i", "content", "detail", "layout"))
    held.execute(f"INSERT INTO f SELECT {columns}", {"i": list(range(len(frames)))} | {c: [f[c] for f in frames] for c in ("content", "detail", "layout")})
    want = held.execute("SELECT round(0.45 * content + 0.25 * detail + 0.30 * layout, 6), round(0.65 * content + 0.35 * detail, 6) FROM f ORDER BY i").fetchall()
    assert [(folds.fullness(f), folds.image_score(f)) for f in frames] == want
    assert any(round(0.45 * f["content"] + 0.25 * f["detail"] + 0.30 * f["layout"], 6) != a for f, (a, _) in zip(frames, want, strict=True))
