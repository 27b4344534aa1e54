import math

import numpy as np
import pandas as pd
import pytest

from cadence.operators import relate as R


def panel(spark, seed=1):
    rng = np.random.default_rng(seed)
    recs = []
    for k in ("a", "b"):
        x = rng.normal(size=12).round(2)
        y = (x * 0.5 + rng.normal(size=12)).round(2)
        z = np.where(np.arange(12) % 4 == 0, np.nan, rng.integers(0, 4, 12).astype(float))
        for t in range(12):
            recs.append((k, t, float(x[t]), float(y[t]), None if np.isnan(z[t]) else float(z[t])))
    pdf = pd.DataFrame(recs, columns=["k", "period", "x", "y", "z"])
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                 "k string, period int, x double, y double, z double"), pdf


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_matches_pandas(spark, method):
    df, pdf = panel(spark)
    fn = R.correlation_matrix if method == "pearson" else R.spearman_matrix
    out = {(r.k, r.metric_x, r.metric_y): r.r for r in
           fn(df, ["k"], "period", ["x", "y", "z"]).collect()}
    for k, g in pdf.groupby("k"):
        ref = g[["x", "y", "z"]].corr(method=method)
        for a in "xyz":
            for b in "xyz":
                assert out[(k, a, b)] == pytest.approx(ref.loc[a, b], abs=1e-9)
                assert out[(k, a, b)] == pytest.approx(out[(k, b, a)], abs=1e-12)


def test_cross_correlation_matches_shift_brute_force(spark):
    df, pdf = panel(spark, 3)
    out = {(r.k, r.lag): (r.r, r.n) for r in
           R.cross_correlation(df, ["k"], "period", "y", "x", use_changes=True).collect()}
    for k, g in pdf.groupby("k"):
        g = g.sort_values("period")
        t = g["y"].pct_change(fill_method=None) * 100
        d = g["x"].pct_change(fill_method=None) * 100
        t = t.replace([np.inf, -np.inf], np.nan)
        d = d.replace([np.inf, -np.inf], np.nan)
        for lag in range(-5, 6):
            pair = pd.DataFrame({"t": t.values, "d": d.shift(lag).values}).dropna()
            r, n = out[(k, lag)]
            assert n == len(pair)
            if len(pair) >= 4:
                assert r == pytest.approx(pair["t"].corr(pair["d"]), abs=1e-9)
            else:
                assert r is None


def test_constant_series_gives_null(spark):
    df = spark.createDataFrame([("a", t, float(t), 1.0) for t in range(5)],
                               "k string, period int, x double, c double")
    out = {(r.metric_x, r.metric_y): r.r for r in
           R.correlation_matrix(df, ["k"], "period", ["x", "c"]).collect()}
    assert out[("x", "c")] is None and out[("c", "c")] is None
    assert math.isclose(out[("x", "x")], 1.0)


def test_spearman_of_ragged_metrics(spark):
    """Metrics with masks of their own, ties, short and empty pairs, null keys."""
    rng = np.random.default_rng(5)
    recs = []
    for k, n in (("a", 20), (None, 15), ("short", 2), ("empty", 3)):
        for t in range(n):
            v = [float(rng.integers(0, 5)), float(rng.normal()), float(rng.normal()), float(t), 3.0]
            gone = [t % 3 == 0, t % 4 == 1, False, k == "empty" or t < 2, False]
            recs.append((k, t, *[None if g else x for x, g in zip(v, gone)]))
    cols = ["x", "y", "z", "t", "c"]
    pdf = pd.DataFrame(recs, columns=["k", "period", *cols])
    df = spark.createDataFrame(recs, "k string, period int, " + ", ".join(f"{c} double" for c in cols))
    out = {(r.k, r.metric_x, r.metric_y): (r.r, r.n) for r in R.spearman_matrix(df, ["k"], "period", cols).collect()}
    assert len(out) == 4 * 25
    for k, g in pdf.groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        for a in cols:
            for b in cols:
                both = g[[a, b]].astype(float)[g[a].notna() & g[b].notna()]
                r, n = out[(k, a, b)]
                assert n == len(both)
                ra, rb = both.iloc[:, 0].rank(), both.iloc[:, 1].rank()
                if n >= 2 and ra.std() > 0 and rb.std() > 0:
                    assert r == pytest.approx(ra.corr(rb), abs=1e-9)
                else:
                    assert r is None


def test_spearman_copies_rows_per_mask_and_ranks_once(spark):
    df = spark.createDataFrame([("a", t, float(t), float(t * t), float(-t)) for t in range(9)], "k string, period int, x double, y double, z double")
    out = R.spearman_matrix(df, ["k"], "period", ["x", "y", "z"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rank(") <= 2 * 3  # one rank a metric (a window names it twice)
    assert {(r.metric_x, r.metric_y): round(r.r, 9) for r in out.collect()}[("x", "z")] == -1.0
    assert R.spearman_matrix(df, ["k"], "period", ["x"]).collect()[0].r == 1.0
