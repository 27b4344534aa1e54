import math

from pyspark.sql import functions as F

from cadence.functions.exprs import combine_text, default_text, finite, guarded_corr, to_number


def test_to_number_strict(spark):
    vals = ["..", "", " 1.5 ", "1d", "inf", "NaN", "1,000", "-2e3", ".5", "7.", None, "abc"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got == [None, None, 1.5, None, None, None, None, -2000.0, 0.5, 7.0, None, None]


def test_finite_turns_nan_and_inf_to_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)],
                               "x double")
    assert [r[0] for r in df.select(finite("x")).collect()] == [1.0, None, None, None, None]


def test_combine_text_order_dedupe_blanks(spark):
    df = spark.createDataFrame([(" a ", "b", "a"), ("", None, "nan"), ("x", "NaN", "x")],
                               "p string, q string, r string")
    got = [r[0] for r in df.select(combine_text("p", "q", "r")).collect()]
    assert got == ["a | b", "", "x"]


def test_default_text(spark):
    df = spark.createDataFrame([("  ",), (None,), (" v ",)], "s string")
    assert [r[0] for r in df.select(default_text("s", "none")).collect()] == ["none", "none", "v"]


def test_guarded_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0),
                                (2, 1.0, 2.0), (2, 2.0, 4.0), (2, None, 1.0)],
                               "k int, x double, y double")
    got = dict(df.groupBy("k").agg(guarded_corr("x", "y").alias("r")).collect())
    assert got[1] is None
    assert math.isclose(got[2], 1.0)
