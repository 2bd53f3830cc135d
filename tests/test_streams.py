"""Streams whose rows come in another order than that of their runs."""

import duckdb
import pandas as pd

from threadloom.plans.queries import ORACLE, QUERIES
from threadloom.streaming import tools


def test_gate_takes_runs_in_order_whatever_frame_they_come_in(spark, tmp_path):
    kinds = ["error", "click", "error", "purchase", "error", "error", "error", "view", "purchase", "click"]
    rows = [(i if i < 399 else None, i % 3, kinds[i // 3 % 7 if i < 200 else i // 3 % 10]) for i in range(400)]
    rows = rows[1::2][::-1] + rows[::2]  # late ones first
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(ORACLE["stream_failure_gate"]).fetchall()
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, 16)
    try:
        got = [tuple(r) for r in QUERIES["stream_failure_gate"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset(size)
    assert sorted(map(str, got)) == sorted(map(str, want)) and {o for _, o in got} == {True, False}


def test_rows_beyond_memory_are_merged(monkeypatch):
    monkeypatch.setattr(tools, "RUN", 50)
    monkeypatch.setattr(tools, "BLOCK", 7)
    rows = [(k % 97 == 0, (k * 7919) % 1009 - 500, k % 3 == 0, k % 5 == 0) for k in range(1009)]
    for n in (0, 6, 49, 50, 1009):
        frames = [pd.DataFrame(rows[k : min(k + 20, n)], columns=list(tools.ROW.names)) for k in range(0, n, 20)]
        blocks = list(tools.in_order(iter(frames)))
        assert [r for b in blocks for r in b] == sorted(rows[:n]) and all(0 < len(b) <= 7 for b in blocks)
