"""Registered streaming query: the daily event panel maintained by
Structured Streaming over the events table."""

from __future__ import annotations

from cadence.plans.registry import register
from cadence.streaming import run_daily_panel


@register("s07_stream_daily_panel", """
SELECT event_type, CAST(ts AS DATE) AS period, CAST(COUNT(*) AS DOUBLE) AS n,
       CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS value_sum
FROM events GROUP BY 1, 2""")
def s07_stream_daily_panel(spark, sf):
    """Streaming source -> daily windows -> update-mode sink ->
    latest version per group (the PC panel's count and value sum)."""
    # fresh folders: every call reads the whole events table
    return run_daily_panel(spark, sf, file_glob="events.parquet")
