import datetime as dt

import pytest
from pyspark.sql import functions as F

from cadence.panel import densify, period_index, series_window, spine, to_long, to_wide
from tests.conftest import rows


def test_long_wide_round_trip_keeps_nulls(spark):
    wide = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, 5.0), ("b", 1, None, 3.0)],
                                 "k string, period int, x double, y double")
    long = to_long(wide, ["k"], "period", ["x", "y"])
    assert long.count() == 6 and long.where(F.col("value").isNull()).count() == 2
    back = to_wide(long, ["k"], "period", ["x", "y"])
    assert rows(back, "k", "period", "x", "y") == rows(wide, "k", "period", "x", "y")


def test_spine_and_densify(spark):
    ents = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    lo, hi = F.lit(dt.date(2000, 1, 1)), F.lit(dt.date(2000, 4, 1))
    grid = spine(ents, ["k"], lo, hi, "month")
    assert grid.count() == 8
    panel = spark.createDataFrame([("a", dt.date(2000, 2, 1), 1.0)], "k string, period date, v double")
    d = densify(panel, ents, ["k"], "period", lo, hi, "month")
    assert d.count() == 8 and d.where(F.col("v").isNotNull()).count() == 1


def test_period_index_and_keyless_window_refused(spark):
    df = spark.createDataFrame([(dt.date(2001, 3, 1),)], "p date")
    assert df.select(period_index("p", "month")).collect()[0][0] == 2001 * 12 + 2
    with pytest.raises(ValueError):
        series_window([], "p")
