import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import transforms as T
from tests.conftest import rows

K = ["k"]
SCHEMA = "k string, period int, value double"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_gap_skipping_vs_gap_preserving(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, 4.0)])
    skip = rows(T.pct_change(df, K, "period", "value", skip_gaps=True), "period", "pct_change")
    keep = rows(T.pct_change(df, K, "period", "value"), "period", "pct_change")
    assert skip == [(1, None), (3, 100.0), (4, 100.0)]
    assert keep == [(1, None), (2, None), (3, None), (4, 100.0)]


def test_base_value_rules(spark):
    df = frame(spark, [("exact", 1, 5.0), ("exact", 2, 10.0), ("exact", 3, 20.0),
                       ("zero", 1, 5.0), ("zero", 2, 0.0), ("zero", 3, 8.0),
                       ("before", 1, 3.0), ("before", 2, 0.0),
                       ("allzero", 1, 0.0), ("allzero", 2, 0.0),
                       ("nullbase", 1, 2.0), ("nullbase", 2, None), ("nullbase", 3, 6.0)])
    got = {r[0]: (r[1], r[2]) for r in
           T.base_value(df, K, "period", "value", 2).select("k", "base_value", "base_period")
           .distinct().collect()}
    assert got["exact"] == (10.0, 2)
    assert got["zero"] == (8.0, 3)         # first later non-zero
    assert got["before"] == (3.0, 1)       # earliest non-zero
    assert got["allzero"] == (None, None)
    assert got["nullbase"] == (6.0, 3)


def test_base100_is_100_at_base_and_omits_zero_series(spark):
    df = frame(spark, [("a", 1, 2.0), ("a", 2, 4.0), ("a", 3, 8.0), ("z", 1, 0.0), ("z", 2, 0.0),
                       ("one", 1, 5.0)])
    out = T.transform_series(df, K, kind="base100", base_period=2)
    got = rows(out, "k", "period", "transformed")
    assert got == [("a", 1, 50.0), ("a", 2, 100.0), ("a", 3, 200.0)]   # 'one' has < 2 points


def test_log10_and_cum_change_and_negative(spark):
    df = frame(spark, [("a", 1, -1.0), ("a", 2, 10.0), ("a", 3, 100.0)])
    lg = rows(T.transform_series(df, K, kind="log10"), "period", "transformed")
    assert lg == [(2, 1.0), (3, 2.0)]
    cc = rows(T.transform_series(df, K, kind="cum_change", base_period=2), "period", "transformed")
    assert [p for p, _ in cc] == [1, 2, 3]
    assert [v for _, v in cc] == pytest.approx([-110.0, 0.0, 900.0])


def test_zscore_mean0_std1_and_constant_omitted(spark):
    data = [("a", i, float(v)) for i, v in enumerate([3, 7, 1, 9, 4], 1)] + \
           [("c", i, 5.0) for i in range(1, 5)]
    out = T.transform_series(frame(spark, data), K, kind="zscore")
    z = np.array([r[0] for r in out.where("k = 'a'").select("transformed").collect()])
    assert math.isclose(z.mean(), 0, abs_tol=1e-12) and math.isclose(z.std(), 1, rel_tol=1e-12)
    assert out.where("k = 'c'").count() == 0


def test_original_scaling_by_unit(spark):
    df = spark.createDataFrame([("a", 1, 2.5e12, "USD"), ("a", 2, 3e12, "USD"),
                                ("p", 1, 4.0, "rate %"), ("p", 2, 5.0, "rate %"),
                                ("h", 1, 2e6, "persons"), ("h", 2, 3e6, "persons")],
                               "k string, period int, value double, unit string")
    out = {(r[0], r[1]): (r[2], r[3]) for r in
           T.transform_series(df, K, kind="original", unit="unit")
           .select("k", "period", "transformed", "axis_label").collect()}
    assert out[("a", 1)] == (2.5, "trillions USD")
    assert out[("p", 2)] == (5.0, "rate %")
    assert out[("h", 1)] == (2.0, "millions of persons")


def test_top_moves_ties_earliest(spark):
    df = frame(spark, [("a", 1, 5.0), ("a", 2, -5.0), ("a", 3, 5.0), ("a", 4, 1.0), ("a", 5, None)])
    got = rows(T.top_moves(df, K, "period", "value", 2), "period", "rank", order=["rank"])
    assert got == [(1, 1), (2, 2)]


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([("a", 1, 10.0, 4.0, 6.0), ("a", 2, 20.0, 5.0, 15.0),
                                ("a", 3, None, 1.0, 1.0), ("b", 1, 5.0, 1.0, 4.0)],
                               "k string, period int, total double, p double, q double")
    out = T.shares(df, K, "period", "total", ["p", "q"])
    got = rows(out, "k", "period", "p_share", "q_share")
    assert got == [("a", 1, 40.0, 60.0), ("a", 2, 25.0, 75.0)]   # b has one complete row


def test_elasticity_threshold(spark):
    # driver changes: +0.09 % (|change| < 0.1 -> dropped) then +0.2 % (kept)
    df = spark.createDataFrame([("a", 1, 100.0, 1000.0), ("a", 2, 110.0, 1000.9),
                                ("a", 3, 121.0, 1000.9 * 1.002)],
                               "k string, period int, t double, d double")
    out = rows(T.elasticity(df, K, "period", "t", "d"), "period", "elasticity")
    assert len(out) == 1 and out[0][0] == 3
    assert math.isclose(out[0][1], 10.0 / 0.2, rel_tol=1e-6)


def test_lag_pair_standardised(spark):
    df = spark.createDataFrame([("a", i, float(i * i), float(i)) for i in range(1, 8)],
                               "k string, period int, t double, d double")
    out = T.lag_pair(df, K, "period", "t", "d", 2, False)
    got = rows(out, "period", "target", "driver_lagged")
    assert got[0] == (3, 9.0, 1.0) and len(got) == 5
    z = np.array([r[0] for r in out.select("target_z").collect()])
    assert math.isclose(z.mean(), 0, abs_tol=1e-12)


def test_local_tail_and_support_guard(spark):
    df = frame(spark, [("a", i, float(i)) for i in range(1, 15)] + [("b", 1, 1.0), ("b", 2, None)])
    tail = rows(T.local_tail(df, K, "period", "value", 12, 10), "k", "period")
    assert tail[0] == ("a", 3) and tail[-1] == ("b", 1) and len(tail) == 11
    kept, rej = T.support_guard(df, K, "value", 2)
    assert rows(rej) == [("b", "insufficient_points", 1)]
    assert kept.where("k = 'b'").count() == 0


def test_panel_convenience(spark):
    from cadence import Panel
    wide = spark.createDataFrame([("a", t, float(t + 1), float(10 - t)) for t in range(6)],
                                 "k string, period int, x double, y double")
    p = Panel(wide, ("k",), "period", ("x", "y"), "year")
    assert p.transform("base100", base_period=0).where("metric = 'x' AND period = 0") \
        .collect()[0].transformed == 100.0
    assert p.trend().count() == 2 and p.coverage().count() == 2
    r = {(x.metric_x, x.metric_y): x.r for x in p.correlations().collect()}
    assert r[("x", "y")] == pytest.approx(-1.0)


def test_transform_warnings(spark):
    df = frame(spark, [("neg", 1, -1.0), ("neg", 2, 0.0), ("neg", 3, 5.0),
                       ("zero", 1, 0.0), ("zero", 2, 0.0), ("flat", 1, 2.0), ("flat", 2, 2.0),
                       ("one", 1, 3.0), ("one", 2, None)])
    got = {(r.k, r.kind, r.warning): r.n for r in
           T.transform_warnings(df, K, ["base100", "log10", "zscore"]).collect()}
    assert got[("neg", "log10", T.WARN_NONPOS)] == 2
    assert got[("zero", "base100", T.WARN_NO_BASE)] == 2
    assert got[("zero", "zscore", T.WARN_ZERO_STD)] == 2 and got[("flat", "zscore", T.WARN_ZERO_STD)] == 2
    assert got[("one", "base100", T.WARN_FEW)] == 1
    assert ("neg", "base100", T.WARN_NO_BASE) not in got


def test_kinds_together_equal_kinds_alone(spark):
    rows_ = [(k, t, None if (t + len(k)) % 5 == 0 else float((t * 7) % 11 - (3 if k == "neg" else 0))) for k in ("a", "neg", "one") for t in range(1 if k == "one" else 14)]
    rows_ += [("const", t, 4.0) for t in range(5)]
    df = spark.createDataFrame(rows_, "k string, period int, value double")
    kinds = list(T.TRANSFORMS)
    together = T.transform_kinds(df, ["k"], kinds, base_period=3)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    for kind in kinds:
        alone = T.transform_series(df, ["k"], kind=kind, base_period=3)
        assert alone.columns == ["k", "period", "original", "transformed", "axis_label", "base_period"]
        assert rows(together.where(f"kind = '{kind}'").drop("kind")) == rows(alone)
