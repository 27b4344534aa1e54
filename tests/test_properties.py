"""Property tests (hypothesis) for the SURVEY invariants, on random small panels."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cadence.operators import relate as R
from cadence.operators import transforms as T
from cadence.operators.forecast import project as PR

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 2))),
                  min_size=2, max_size=12)


def series_df(spark, vals):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(vals)],
                                 "k string, period int, value double")


@SETTINGS
@given(vals=values, base=st.integers(0, 11))
def test_base100_is_100_at_the_base_used(spark, vals, base):
    out = T.transform_series(series_df(spark, vals), ["k"], kind="base100", base_period=base).collect()
    for r in out:
        if r.period == r.base_period:
            assert r.transformed == pytest.approx(100.0)
    nonzero = [v for v in vals if v not in (None, 0.0)]
    if len([v for v in vals if v is not None]) >= 2 and nonzero:
        assert out, "series with a non-zero point must produce an index"


@SETTINGS
@given(parts=st.lists(st.tuples(st.integers(1, 10_000), st.integers(1, 10_000)), min_size=2, max_size=8))
def test_shares_sum_to_100(spark, parts):
    df = spark.createDataFrame([("s", i, float(a + b), float(a), float(b)) for i, (a, b) in enumerate(parts)],
                               "k string, period int, total double, p double, q double")
    for r in T.shares(df, ["k"], "period", "total", ["p", "q"]).collect():
        assert r.p_share + r.q_share == pytest.approx(100.0)


@SETTINGS
@given(vals=st.lists(st.floats(-1e4, 1e4, allow_nan=False), min_size=3, max_size=12))
def test_zscore_standardises(spark, vals):
    out = [r.transformed for r in
           T.transform_series(series_df(spark, vals), ["k"], kind="zscore").collect()]
    if np.std(vals) > 1e-9 * max(1.0, np.max(np.abs(vals))):
        assert np.mean(out) == pytest.approx(0.0, abs=1e-6)
        assert np.std(out) == pytest.approx(1.0, rel=1e-6)


@SETTINGS
@given(levels=st.lists(st.floats(1, 1e6, allow_nan=False), min_size=2, max_size=8))
def test_recursive_levels_invert_growth(spark, levels):
    g = [(levels[i] / levels[i - 1] - 1) * 100 for i in range(1, len(levels))]
    fut = spark.createDataFrame([("s", i + 1, x) for i, x in enumerate(g)],
                                "k string, step int, predicted_model double")
    last = spark.createDataFrame([("s", levels[0])], "k string, last_level double")
    got = [r.predicted for r in PR.recursive_levels(fut, last, ["k"], "growth").orderBy("step").collect()]
    assert got == pytest.approx(levels[1:], rel=1e-9)


@SETTINGS
@given(rows=st.lists(st.tuples(st.floats(-100, 100, allow_nan=False),
                               st.floats(-100, 100, allow_nan=False),
                               st.one_of(st.none(), st.floats(-100, 100, allow_nan=False))),
                     min_size=3, max_size=10))
def test_correlation_symmetric_with_unit_diagonal(spark, rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)],
                               "k string, period int, a double, b double, c double")
    out = {(r.metric_x, r.metric_y): r.r for r in
           R.correlation_matrix(df, ["k"], "period", ["a", "b", "c"]).collect()}
    for (x, y), r in out.items():
        o = out[(y, x)]
        assert (r is None and o is None) or r == pytest.approx(o, abs=1e-12)
        if x == y and r is not None:
            assert r == pytest.approx(1.0)
        if r is not None:
            assert -1 - 1e-9 <= r <= 1 + 1e-9


@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 10_000), p=st.integers(1, 4), n=st.integers(8, 40))
def test_exact_elastic_net_satisfies_kkt(seed, p, n):
    from cadence.operators.forecast import solvers as SV
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, p))
    y = z @ rng.normal(size=p) + rng.normal(size=n)
    s = SV.Stats(*(np.asarray(x)[None] for x in (n, z.sum(0), y.sum(), z.T @ z, z.T @ y, y @ y)))
    g, c, _ = s.centred()
    a, r = np.broadcast_arrays(SV.ALPHAS[None, ::11], SV.L1_RATIOS[:, None])
    w, met = SV.coordinate_descent(g, c, s.n, a.reshape(1, -1), r.reshape(1, -1), np.ones(1))
    assert met.all()
    w, g, c = w[0].reshape(*a.shape, p), g[0], c[0]
    l1 = np.broadcast_to(n * a * r, w.shape[:-1])
    l2 = np.broadcast_to(n * a * (1 - r), w.shape[:-1])
    grad = c - w @ g - l2[..., None] * w            # = l1 * sign(w) where w != 0
    scale = 1e-6 * max(1.0, float(np.abs(c).max()))
    active = np.abs(w) > 1e-12
    assert np.all(np.abs(grad - l1[..., None] * np.sign(w))[active] <= scale)
    assert np.all((np.abs(grad) <= l1[..., None] + scale)[~active])
