"""cadence — panel time-series analytics on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function over a *panel*:
many entities (``keys``) x one ordered ``period`` column x one or more metrics.
Windows are always partitioned by the entity keys (plus ``metric`` in long
form), so the same call serves one series or millions of them.
"""

from cadence.panel import Panel, series_window, to_long, to_wide

__all__ = ["Panel", "series_window", "to_long", "to_wide"]
