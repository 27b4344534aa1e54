import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators.forecast import boost as B
from cadence.operators.forecast import features as FE
from cadence.operators.forecast import pipeline as PL
from cadence.operators.forecast import project as PR
from cadence.operators.forecast import solvers as SV


def block(z, y, number=0):
    return {"block": number, "n": len(y), "sz": z.sum(0), "sy": y.sum(), "szz": (z.T @ z).ravel(), "szy": z.T @ y, "syy": y @ y}


def stats_of(z, y):
    """Statistics of one fit."""
    return SV.Stats.of_blocks([[block(z, y)]]).over(slice(None))


def descend(s, alphas, ratios):
    """Coordinate descent of one fit over a grid; w and whether all met the tolerance."""
    g, c, _ = s.centred()
    a, r = np.broadcast_arrays(alphas, ratios)
    w, met = SV.coordinate_descent(g, c, s.n, a.reshape(1, -1), r.reshape(1, -1), np.ones(1))
    return w[0].reshape(*a.shape, -1), met.all()


def data(seed=0, n=40, p=3):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, p))
    y = 1.5 + z @ np.array([2.0, -1.0, 0.5])[:p] + rng.normal(scale=0.3, size=n)
    return z, y


def test_ols_from_stats_equals_lstsq():
    z, y = data()
    b0, w, _ = SV.ols(stats_of(z, y))
    ref, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), z]), y, rcond=None)
    assert np.allclose([b0[0], *w[0]], ref, atol=1e-10)


def test_sse_from_stats():
    z, y = data(1)
    w = np.array([0.3, 0.2, -0.1])
    found = stats_of(z, y).sse(np.array([0.7]), w[None])
    assert found[0] == pytest.approx(np.sum((y - 0.7 - z @ w) ** 2), rel=1e-10)


def test_elastic_net_tiny_alpha_is_ols_and_kkt_holds():
    z, y = data(2)
    s = stats_of(z, y)
    w, _ = descend(s, 1e-12, 0.5)
    assert np.allclose(w, SV.ols(s)[1], atol=1e-6)
    alpha, rho = 0.3, 0.7
    w, _ = descend(s, alpha, rho)
    g, c, _ = (x[0] for x in s.centred())
    grad = (c - g @ w) / len(y) - alpha * (1 - rho) * w          # = alpha*rho*sign(w) on the support
    for j in range(w.size):
        if abs(w[j]) > 1e-9:
            assert grad[j] == pytest.approx(alpha * rho * np.sign(w[j]), abs=1e-7)
        else:
            assert abs(grad[j]) <= alpha * rho + 1e-7


def folds_of(z, y, k):
    ts = len(y) // (k + 1)
    first = len(y) - k * ts
    ends = [first + i * ts for i in range(k + 1)]
    return [block(z[:first], y[:first])] + [block(z[a:b], y[a:b], i + 1) for i, (a, b) in enumerate(zip(ends, ends[1:]))], ends


def test_elastic_net_fold_selection_from_blocks():
    z, y = data(3, n=30)
    blocks, ends = folds_of(z, y, 5)
    b0, w, extra = SV.elastic_net(SV.Stats.of_blocks([blocks]), np.array([5]))

    # brute force: evaluate the chosen and a few other grid points directly on raw rows
    def cv(alpha, rho):
        errs = []
        for lo, hi in zip(ends, ends[1:]):
            s = stats_of(z[:lo], y[:lo])
            wi, _ = descend(s, alpha, rho)
            errs.append(np.mean((y[lo:hi] - s.intercept(wi[None])[0] - z[lo:hi] @ wi) ** 2))
        return np.mean(errs)
    best = cv(extra["alpha"][0], extra["l1_ratio"][0])
    for a in (SV.ALPHAS[0], SV.ALPHAS[60], SV.ALPHAS[-1]):
        for r in (0.05, 0.5, 0.95):
            assert best <= cv(a, r) * (1 + 1e-8)


def test_stacked_fits_equal_single_ones():
    """Fits of different length, fold count and convergence do not touch each other."""
    series = [(*data(20 + i, n=n, p=2), k) for i, (n, k) in enumerate([(12, 2), (40, 5), (17, 3), (60, 5), (9, 2)])]
    blocks, ks = [folds_of(z, y, k)[0] for z, y, k in series], np.array([k for _, _, k in series])
    stack = SV.Stats.of_blocks(blocks)
    for solve in (lambda b, k: SV.elastic_net(b, k), lambda b, k: SV.bayesian_ridge(b.over(slice(None))), lambda b, k: SV.ols(b.over(slice(None)))):
        b0, w, extra = solve(stack, ks)
        for i, one in enumerate(blocks):
            b1, w1, extra1 = solve(SV.Stats.of_blocks([one]), ks[i:i + 1])
            assert np.allclose(b0[i], b1[0], rtol=1e-9) and np.allclose(w[i], w1[0], rtol=1e-7, atol=1e-9)
            for name, x in extra.items():
                assert np.allclose(x[i], extra1[name][0], rtol=1e-7), name


def bayes_direct(z, y, iters=300, tol=1e-3):
    """Brute-force evidence maximisation on the raw centred rows (SVD path)."""
    zc, yc = z - z.mean(0), y - y.mean()
    n = len(y)
    u, sv, vh = np.linalg.svd(zc, full_matrices=False)
    ev = sv ** 2
    alpha, lam = 1.0 / (np.var(y) + np.finfo(float).eps), 1.0
    xty = zc.T @ yc
    w_old = None
    for it in range(iters):
        w = vh.T @ ((vh @ xty) / (ev + lam / alpha))
        rss = np.sum((yc - zc @ w) ** 2)
        gamma = np.sum(alpha * ev / (lam + alpha * ev))
        lam = (gamma + 2e-6) / (np.sum(w ** 2) + 2e-6)
        alpha = (n - gamma + 2e-6) / (rss + 2e-6)
        if it and np.sum(np.abs(w_old - w)) < tol:
            break
        w_old = w.copy()
    w = vh.T @ ((vh @ xty) / (ev + lam / alpha))
    return w, alpha, lam


def test_bayesian_ridge_matches_direct():
    z, y = data(4)
    _, w, extra = SV.bayesian_ridge(stats_of(z, y))
    w_ref, a_ref, l_ref = bayes_direct(z, y)
    assert np.allclose(w[0], w_ref, atol=1e-8)
    assert extra["noise_precision"][0] == pytest.approx(a_ref, rel=1e-8)
    assert extra["weight_precision"][0] == pytest.approx(l_ref, rel=1e-8)
    zc = z - z.mean(0)
    sigma = np.linalg.inv(a_ref * zc.T @ zc + l_ref * np.eye(3))
    assert np.allclose(extra["posterior_std"][0], np.sqrt(np.diag(sigma)), rtol=1e-8)


def exact_panel(spark):
    """Levels whose growth is exactly 2 + 0.1*trend + 0.5*driver(t-1)."""
    recs = []
    for k, x0 in (("a", 1.0), ("b", 3.0)):
        level = 100.0
        drivers = [x0 + ((t * 7) % 5) for t in range(30)]
        for t in range(30):
            if t > 0:
                g = 2 + 0.1 * (t) + 0.5 * drivers[t - 1]
                level = level * (1 + g / 100)
            recs.append((k, 2000 + t, level, drivers[t]))
    return spark.createDataFrame(recs, "k string, period int, y double, x double")


def test_fit_predict_exact_fit_and_projection(spark):
    df = exact_panel(spark)
    out = PL.fit_predict(df, ["k"], "period", "y", ["x"], model="ols", lag=1, horizon=3,
                         mode="growth", cutoff=2025, freq="year")
    hist = out["predictions"].where("kind = 'history'").toPandas()
    ok = hist.dropna(subset=["predicted"])
    assert np.allclose(ok["predicted"], ok["actual"], rtol=1e-9)
    m = {r.k: r for r in out["metrics"].collect()}
    assert m["a"].r2_in == pytest.approx(1.0) and m["a"].n == 25 and m["a"].n_holdout == 5
    proj = out["predictions"].where("kind = 'projection'").orderBy("k", "period").toPandas()
    assert list(proj["period"][:3]) == [2026, 2027, 2028]
    # projection starts from the last observed level at the cut-off (2025)
    last = df.where("k = 'a' AND period = 2025").collect()[0].y
    g = proj[proj.k == "a"]["predicted_model"].to_numpy()
    assert proj[proj.k == "a"]["predicted"].iloc[0] == pytest.approx(last * (1 + g[0] / 100))


def test_recursive_levels_handles_minus_100_and_below(spark):
    fut = spark.createDataFrame([("a", 1, 10.0), ("a", 2, -100.0), ("a", 3, 50.0),
                                 ("b", 1, -150.0)], "k string, step int, predicted_model double")
    last = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "k string, last_level double")
    got = {(r.k, r.step): r.predicted for r in PR.recursive_levels(fut, last, ["k"], "growth").collect()}
    assert got[("a", 1)] == pytest.approx(110.0)
    assert got[("a", 2)] == 0.0 and got[("a", 3)] == 0.0
    assert got[("b", 1)] == pytest.approx(-50.0)


def test_recursive_levels_inverts_target_transform(spark):
    lv = [100.0, 120.0, 90.0, 95.0]
    g = [(lv[i] / lv[i - 1] - 1) * 100 for i in range(1, 4)]
    fut = spark.createDataFrame([("a", i + 1, g[i]) for i in range(3)],
                                "k string, step int, predicted_model double")
    last = spark.createDataFrame([("a", 100.0)], "k string, last_level double")
    got = [r.predicted for r in PR.recursive_levels(fut, last, ["k"], "growth").orderBy("step").collect()]
    assert got == pytest.approx(lv[1:], rel=1e-12)
    d = [lv[i] - lv[i - 1] for i in range(1, 4)]
    fut = spark.createDataFrame([("a", i + 1, d[i]) for i in range(3)],
                                "k string, step int, predicted_model double")
    got = [r.predicted for r in PR.recursive_levels(fut, last, ["k"], "diff").orderBy("step").collect()]
    assert got == pytest.approx(lv[1:])


def test_holdout_sizes(spark):
    frame = spark.createDataFrame([("a", t) for t in range(20)] + [("b", t) for t in range(7)],
                                  "k string, period int")
    out = FE.holdout_split(frame, ["k"], "period", 2)
    tn = {r.k: r.test_n for r in out.select("k", "test_n").distinct().collect()}
    assert tn == {"a": 4, "b": 0}
    assert out.where("k = 'a' AND is_test").agg(F.min("period")).collect()[0][0] == 16


def test_driver_trend_and_known_values(spark):
    df = spark.createDataFrame([("a", 2000 + t, 2.0 * t + 1) for t in range(15)] + [("b", 2000, 1.0)],
                               "k string, period int, x double")
    lines, rej = PR.driver_trend(df, ["k"], "period", "x", 2012, "year", 10)
    l = lines.collect()[0]
    assert l.n == 10 and l.slope == pytest.approx(2.0)
    assert [r.k for r in rej.collect()] == ["b"]
    grid = PR.future_grid(df.where("k='a'"), ["k"], 2012, 3, 1, "year")
    out = PR.known_else_trend(grid, df, lines, ["k"], "period", "x", 2012, "year")
    vals = {r.step: r.driver_value for r in out.collect()}
    assert vals[1] == 25.0                       # known at 2012
    assert vals[2] == pytest.approx(27.0)        # extrapolated (2013 is after the cut-off)


def test_level_ols_exact(spark):
    recs = [("a", 2000 + t, 3.0 + 2.0 * t + 4.0 * ((t - 1) % 3), float(t % 3)) for t in range(12)]
    df = spark.createDataFrame(recs, "k string, period int, y double, x double")
    out = PL.level_ols(df, ["k"], "period", "y", ["x"], lag=1, horizon=2, freq="year")
    m = out["metrics"].collect()[0]
    assert m.r2 == pytest.approx(1.0) and m.n == 11
    assert out["predictions"].where("kind='projection'").count() == 2


def enet_exact(g: np.ndarray, c: np.ndarray, n: float, alphas: np.ndarray, rhos: np.ndarray,
                kkt_tol: float = 1e-9):
    """Exact elastic-net solution for a whole grid when p is small: with
    l1 ratio < 1 the objective is strictly convex, so exactly one sign
    pattern s in {-1, 0, 1}^p satisfies the KKT conditions
        (G_AA + n*a*(1-r) I) w_A = c_A - n*a*r*s_A,  sign(w_A) = s_A,
        |c_j - G_jA w_A| <= n*a*r  for inactive j.
    Every pattern is solved batched over the grid; grid points left without
    a consistent pattern (numerical ties) are returned as NaN."""
    import itertools
    p = c.size
    shape = np.broadcast(alphas, rhos).shape
    l1 = np.broadcast_to(n * alphas * rhos, shape)
    l2 = np.broadcast_to(n * alphas * (1 - rhos), shape)
    w = np.full(shape + (p,), np.nan)
    done = np.zeros(shape, bool)
    scale = max(1.0, float(np.max(np.abs(c))))
    for pattern in itertools.product((0, 1, -1), repeat=p):
        sgn = np.array(pattern, float)
        act = sgn != 0
        k = int(act.sum())
        cand = np.zeros(shape + (p,))
        if k:
            m = g[np.ix_(act, act)][None] + l2.reshape(-1)[:, None, None] * np.eye(k)[None]
            rhs = c[act][None] - l1.reshape(-1)[:, None] * sgn[act][None]
            sol = np.linalg.solve(m, rhs[..., None])[..., 0].reshape(shape + (k,))
            cand[..., act] = sol
            ok = np.all(sol * sgn[act] > 0, axis=-1)
        else:
            ok = np.ones(shape, bool)
        if k < p:
            resid = c[~act] - cand @ g[:, ~act]
            ok &= np.all(np.abs(resid) <= l1[..., None] + kkt_tol * scale, axis=-1)
        new = ok & ~done
        w[new] = cand[new]
        done |= new
        if done.all():
            break
    return w


def test_level_ols_with_drivers_of_any_size(spark):
    rng = np.random.default_rng(3)
    for size in (1.0, 1e9, 1e13):
        x = size * (1 + rng.random(36))
        y = 3.0 + 2.0 * np.arange(36) + 5.0 * np.roll(x, 1) / size + rng.normal(scale=0.1, size=36)
        df = spark.createDataFrame([("a", 2000 + t, float(y[t]), float(x[t])) for t in range(36)], "k string, period int, y double, x double")
        out = PL.level_ols(df, ["k"], "period", "y", ["x"], lag=1, horizon=2, freq="year")
        design = np.column_stack([np.ones(35), np.arange(35), x[:-1] / size])
        want = np.linalg.lstsq(design, y[1:], rcond=None)[0]
        c = out["coefficients"].collect()[0]
        assert [c.intercept, c.coef[0], c.coef[1] * size] == pytest.approx(want, rel=1e-6)
        assert out["metrics"].collect()[0].rmse == pytest.approx(np.sqrt(np.mean((y[1:] - design @ want) ** 2)), rel=1e-6)


def test_no_entity_vanishes(spark):
    rows = [("full", 2000 + t, 100.0 + t * t, float(t % 4 + 1)) for t in range(20)]
    rows += [("short", 2000 + t, 1.0 + t, 1.0 + t) for t in range(3)] + [("empty", 2000, None, None), ("late", 2050, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, period int, y double, x double")
    out = PL.fit_predict(df, ["k"], "period", "y", ["x"], cutoff=2019, freq="year")
    kept = {r.k for r in out["frame"].select("k").distinct().collect()}
    rejected = {r.k: r.n for r in out["rejections"].collect()}
    assert kept == {"full"} and set(rejected) == {"short", "empty", "late"} and rejected["empty"] == rejected["late"] == 0
    entities = spark.createDataFrame([("short",), ("empty",)], "k string")
    lines, rej = PR.driver_trend(df, ["k"], "period", "x", 2019, "year", 10, entities)
    assert [r.k for r in lines.collect()] == ["short"] and [(r.k, r.n) for r in rej.collect()] == [("empty", 0)]


@pytest.mark.parametrize("p", [1, 2, 4])
def test_exact_elastic_net_matches_coordinate_descent(p):
    z, y = data(5 + p, n=50, p=p) if p <= 3 else (np.random.default_rng(9).normal(size=(50, p)),
                                                    np.random.default_rng(9).normal(size=50))
    s = stats_of(z, y)
    g, c, _ = (x[0] for x in s.centred())
    a, r = SV.ALPHAS[None, ::7], SV.L1_RATIOS[:, None]
    exact = enet_exact(g, c, s.n[0], a, r)
    cd, met = descend(s, a, r)
    assert met
    assert not np.isnan(exact).any()
    assert np.allclose(exact, cd, atol=1e-7)


def test_fit_predict_column_contract(spark):
    df = spark.createDataFrame([("a", 2000, 1.0)], "k string, period int, y double")
    with pytest.raises(ValueError, match="missing columns"):
        PL.fit_predict(df, ["k"], "period", "y", ["x"], cutoff=2000, freq="year")


def brute_split(x, r, rows):
    """Best split of some rows: (feature, threshold, gain), or None."""
    found = []
    for j in range(x.shape[1]):
        for low, high in zip(sorted({x[i, j] for i in rows}), sorted({x[i, j] for i in rows})[1:]):
            left, right = [i for i in rows if x[i, j] <= low], [i for i in rows if x[i, j] > low]
            if min(len(left), len(right)) >= 2:
                gap = np.mean([r[i] for i in left]) - np.mean([r[i] for i in right])
                found.append((len(left) * len(right) / len(rows) * gap ** 2, j, low / 2 + high / 2))
    best = max((g for g, _, _ in found), default=0)
    return next(((j, t, g) for g, j, t in found if g >= best * (1 - 1e-9)), None) if best > 1e-12 else None


def brute_boost(x, y, future):
    """Huber boosting of one series from the rule, row by row."""
    raw, out = np.full(len(y), np.median(y)), np.full(len(future), np.median(y))
    gain = np.zeros(x.shape[1])
    for _ in range(B.N_TREES):
        error = y - raw
        delta = np.quantile(np.abs(error), 0.9)
        r = np.clip(error, -delta, delta)
        nodes = [(list(range(len(y))), list(range(len(future))))]
        for _ in range(2):
            deeper = []
            for rows, new in nodes:
                split = brute_split(x, r, rows) if rows else None
                if split is None:
                    deeper.append((rows, new))
                    continue
                j, t, g = split
                gain[j] += g
                for side in (False, True):
                    deeper.append(([i for i in rows if (x[i, j] > t) == side], [i for i in new if (future[i, j] > t) == side]))
            nodes = deeper
        for rows, new in nodes:
            middle = np.median(error[rows])
            value = middle + np.mean(np.clip(error[rows] - middle, -delta, delta))
            raw[rows] += 0.03 * value
            out[new] += 0.03 * value
    return raw, out, gain / gain.sum() if gain.sum() else gain


def boosted_panel(spark, lengths, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(lengths):
        x = np.round(rng.normal(5, 2, n), 1)  # values that repeat
        y = 100 + 3 * np.arange(n) + 10 * np.sin(x) + rng.normal(size=n) + 40 * (rng.random(n) < 0.06)
        rows += [(f"e{k}", 1990 + t, float(y[t]), float(x[t])) for t in range(n)]
    return spark.createDataFrame(rows, "k string, period int, y double, x double")


@pytest.mark.parametrize("mode", ["growth", "diff", "level"])
def test_boosting_equals_brute_force(spark, mode):
    df = boosted_panel(spark, [14, 31, 45])
    out = PL.fit_predict(df, ["k"], "period", "y", ["x"], model="gbt", lag=1, horizon=3, mode=mode, cutoff=2040, freq="year")
    frame = out["frame"].orderBy("k", "period").toPandas()
    found = out["predictions"].orderBy("k", "period").toPandas()
    held = out["holdout"].orderBy("k", "period").toPandas()
    importance = {(r.k, r.feature): r.importance for r in PR.importance(out["coefficients"], ["k"], ["trend", "x_lag1"]).collect()}
    for k, rows in frame.groupby("k"):
        x, y = rows[["trend", "x_lag1"]].to_numpy(), rows["target_model"].to_numpy()
        proj = found[(found.k == k) & (found.kind == "projection")]
        future = out["predictions"].where(f"k = '{k}' AND kind = 'projection'").count()
        assert future == 3
        fitted, _, gain = brute_boost(x, y, x[:1])
        history = found[(found.k == k) & (found.kind == "history")]
        assert np.allclose(history["predicted_model"], fitted, rtol=1e-9)
        assert [importance[k, f] for f in ("trend", "x_lag1")] == pytest.approx(list(gain), rel=1e-6, abs=1e-9)
        test = rows["is_test"].to_numpy()
        if test.any():
            _, ahead, _ = brute_boost(x[~test], y[~test], x[test])
            assert np.allclose(held[held.k == k]["predicted_model"], ahead, rtol=1e-9)
        assert np.isfinite(proj["predicted"]).all()
    m = out["metrics"].first()
    assert (m.n_trees, m.max_depth, m.learning_rate, m.min_leaf, m.loss) == (300, 2, 0.03, 2, "huber")


def test_boosting_edges():
    """A constant target, one constant feature and more distinct values than bins."""
    live = np.ones((2, 12), bool)
    x = np.stack([np.column_stack([np.arange(12.0), np.ones(12)])] * 2)
    found = B.boost(x, np.stack([np.full(12, 7.0), np.arange(12.0)]), live)
    assert np.allclose(found["fitted"][0], 7.0) and found["importance"][0].tolist() == [0, 0] and found["importance"][1].tolist() == [1, 0]
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1, 3000, 1))
    found = B.boost(x, 5 * (x[..., 0] > 0.3), np.ones((1, 3000), bool))
    assert B.bins_of(x[0, :, 0]).max() == B.BINS - 1 and np.mean(np.abs(found["fitted"] - 5 * (x[..., 0] > 0.3)) > 0.5) < 0.01


def test_recursive_levels_of_a_long_horizon(spark):
    n = 2000
    fut = spark.range(1, n + 1).selectExpr("'a' AS k", "CAST(id AS int) AS step", "CASE WHEN id % 2 = 0 THEN 1.0 ELSE -0.5 END AS predicted_model")
    last = spark.createDataFrame([("a", 50.0)], "k string, last_level double")
    for mode in ("growth", "diff"):
        got = [r.predicted for r in PR.recursive_levels(fut, last, ["k"], mode).orderBy("step").collect()]
        want, level = [], 50.0
        for i in range(1, n + 1):
            g = 1.0 if i % 2 == 0 else -0.5
            level = level * (1 + g / 100) if mode == "growth" else level + g
            want.append(level)
        assert got == pytest.approx(want, rel=1e-9)
