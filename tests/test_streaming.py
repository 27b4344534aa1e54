import datetime as dt

from cadence.streaming import run_daily_panel
from cadence.streaming.panel_stream import EVENTS_SCHEMA


def write_events(spark, path, rows):
    spark.createDataFrame(rows, EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def ev(i, day, etype, value):
    return (i, dt.datetime(2024, 1, day, 12, 0), 1, etype, value, "{}")


def test_incremental_restart_and_late_data(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ck")
    write_events(spark, src, [ev(1, 9, "a", 1.25), ev(2, 10, "a", 2.5), ev(3, 10, "b", 1.0)])
    p1 = {(r.event_type, r.period.day): (r.n, r.value_sum) for r in
          run_daily_panel(spark, src, out, ck).collect()}
    assert p1 == {("a", 9): (1.0, 1.25), ("a", 10): (1.0, 2.5), ("b", 10): (1.0, 1.0)}
    # second batch: an update to day 10 and an event nine days late
    write_events(spark, src, [ev(4, 10, "a", 0.5), ev(5, 1, "a", 9.0)])
    p2 = {(r.event_type, r.period.day): (r.n, r.value_sum) for r in
          run_daily_panel(spark, src, out, ck).collect()}
    assert p2[("a", 10)] == (2.0, 3.0)          # restart resumed from the checkpoint
    assert p2[("a", 1)] == (1.0, 9.0)           # late events count
