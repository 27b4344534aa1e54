"""Registered forecasting queries.

Entity = customer nation on the densified monthly PB panel (and customer for
the support guard); target = order value, predictor = order count lagged one
period, growth mode, cut-off 2000-12, horizon 6.  With a trend and one driver
the DuckDB oracles solve OLS by Cramer's rule, the elastic net by its nine sign
patterns and Bayesian ridge by a recursive query; boosting is held against a
brute-force booster in ``tests/``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadence.operators.forecast import features as FE
from cadence.operators.forecast import pipeline as PL
from cadence.operators.forecast import project as PR
from cadence.panel import add_periods, month_start
from cadence.plans import sql as S
from cadence.plans.panels import build_pb, dollars, money, read
from cadence.plans.registry import register, rnd, sig

KEYS = ["c_nationkey"]
CUT = dt.date(2000, 12, 1)
CUT_SQL = "DATE '2000-12-01'"
H = 6
LAG = 1
FEATS = FE.feature_names(["order_count"], LAG)


def pb_df(spark, sf):
    return build_pb(spark, sf).df


def run(spark, sf, model="ols", mode="growth"):
    return PL.fit_predict(pb_df(spark, sf), KEYS, "period", "order_value", ["order_count"],
                          model=model, lag=LAG, horizon=H, mode=mode, cutoff=CUT, freq="month")


def frame_sql(src: str = "pb", key: str = "c_nationkey") -> str:
    return f"""
fr AS (
  SELECT {key}, period, order_value AS target_level,
         (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS target_model,
         CAST(date_diff('month', MIN(period) OVER (PARTITION BY {key}), period) AS DOUBLE) AS trend,
         lag(order_count, 1) OVER w AS order_count_lag1
  FROM {src} WHERE period <= {CUT_SQL}
  WINDOW w AS (PARTITION BY {key} ORDER BY period)),
mf AS (SELECT * FROM fr WHERE target_level IS NOT NULL AND target_model IS NOT NULL
         AND order_count_lag1 IS NOT NULL)"""


SPLIT_SQL = S.PB_WIDE + "," + frame_sql() + """,
kept AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY c_nationkey) AS n FROM mf) WHERE n >= 10),
ho AS (SELECT *, CASE WHEN tn >= 2 THEN tn ELSE 0 END AS test_n
       FROM (SELECT *, LEAST(GREATEST(3, CAST(round(n * 0.2) AS BIGINT)), n - 6) AS tn FROM kept)),
hs AS (SELECT * EXCLUDE (tn), row_number() OVER (PARTITION BY c_nationkey ORDER BY period DESC) <= test_n
              AS is_test FROM ho)"""


def coef_sql(name: str, where: str) -> str:
    return f"""
{name}_s AS (SELECT c_nationkey, AVG(trend) AS m1, AVG(order_count_lag1) AS m2, AVG(target_model) AS my,
              COVAR_POP(trend, trend) AS s11, COVAR_POP(trend, order_count_lag1) AS s12,
              COVAR_POP(order_count_lag1, order_count_lag1) AS s22,
              COVAR_POP(trend, target_model) AS s1y, COVAR_POP(order_count_lag1, target_model) AS s2y
       FROM hs WHERE {where} GROUP BY 1),
{name}_b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                       (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM {name}_s),
{name} AS (SELECT c_nationkey, b1, b2, my - b1 * m1 - b2 * m2 AS b0 FROM {name}_b)"""


OLS_SQL = SPLIT_SQL + "," + coef_sql("cf", "TRUE") + "," + coef_sql("ct", "test_n > 0 AND NOT is_test") + """,
ins AS (SELECT hs.*, cf.b0 + cf.b1 * trend + cf.b2 * order_count_lag1 AS predicted_model
        FROM hs JOIN cf USING (c_nationkey)),
hol AS (SELECT hs.*, ct.b0 + ct.b1 * trend + ct.b2 * order_count_lag1 AS predicted_model
        FROM hs JOIN ct USING (c_nationkey) WHERE is_test)"""


@register("m01_feature_frame", S.with_(S.PB_WIDE, frame_sql()) + "SELECT * FROM mf")
def m01_feature_frame(spark, sf):
    """M1: model frame up to the cut-off: growth target, order count lagged
    one period, trend, complete cases."""
    return FE.feature_frame(pb_df(spark, sf), KEYS, "period", "order_value", ["order_count"],
                            LAG, "growth", CUT, "month")


@register("m02_target_modes", S.with_(S.PB_WIDE) + f"""
SELECT c_nationkey, period, order_value AS target_level,
       (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS target_growth,
       order_value - lag(order_value) OVER w AS target_diff
FROM pb WHERE period <= {CUT_SQL} WINDOW w AS (PARTITION BY c_nationkey ORDER BY period)""")
def m02_target_modes(spark, sf):
    """M2: the three target modes side by side (growth %, difference, level)."""
    from cadence.panel import series_window
    w = series_window(KEYS, "period")
    d = pb_df(spark, sf).where(F.col("period") <= F.lit(CUT)).select(
        *KEYS, "period", F.col("order_value").alias("target_level"))
    return d.withColumns({"target_growth": FE.target_transform("target_level", "growth", w),
                          "target_diff": FE.target_transform("target_level", "diff", w)})


def customer_panel(spark, sf):
    o = read(spark, sf, "orders")
    return o.groupBy("o_custkey", month_start("o_orderdate").alias("period")).agg(
        dollars(F.sum(money("o_totalprice"))).alias("order_value"),
        F.count(F.lit(1)).cast("double").alias("order_count"))


CUST_SQL = """
pcu AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
               CAST(SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS order_value,
               CAST(COUNT(*) AS DOUBLE) AS order_count FROM orders GROUP BY 1, 2)"""


@register("m03_support_guard", S.with_(CUST_SQL, frame_sql("pcu", "o_custkey")) + """
SELECT o_custkey, 'fewer than 10 complete observations' AS reason, COUNT(mf.period) AS n
FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN mf USING (o_custkey) GROUP BY 1 HAVING COUNT(mf.period) < 10""")
def m03_support_guard(spark, sf):
    """M3: per-customer model frames with fewer than max(10, p + 5) complete
    rows are rejected with their count, 0 included."""
    panel = customer_panel(spark, sf)
    frame = FE.feature_frame(panel, ["o_custkey"], "period", "order_value",
                             ["order_count"], LAG, "growth", CUT, "month")
    _, rej = FE.support_split(frame, ["o_custkey"], FE.minimum_support(len(FEATS)), panel)
    return rej


@register("m04_holdout_split", S.with_(SPLIT_SQL) + "SELECT * FROM hs")
def m04_holdout_split(spark, sf):
    """M4: temporal hold-out flags (last max(3, round(0.2 n)) rows, capped)."""
    frame = FE.feature_frame(pb_df(spark, sf), KEYS, "period", "order_value", ["order_count"],
                             LAG, "growth", CUT, "month")
    kept, _ = FE.support_split(frame, KEYS, FE.minimum_support(len(FEATS)))
    return FE.holdout_split(kept, KEYS, "period", len(FEATS))


def _z(col: str) -> str:
    sd = f"STDDEV_POP({col}) OVER ws"
    return (f"round(({col} - AVG({col}) OVER ws) / CASE WHEN {sd} > 0 THEN {sd} ELSE 1.0 END, 6) "
            f"+ 0.0 AS z_{col}")


@register("m05_standardise", S.with_(SPLIT_SQL, """
sc AS (SELECT *, 'full' AS scope FROM hs UNION ALL
       SELECT *, 'train' FROM hs WHERE test_n > 0 AND NOT is_test)""") + f"""
SELECT c_nationkey, scope, period, {_z('trend')}, {_z('order_count_lag1')}
FROM sc WINDOW ws AS (PARTITION BY c_nationkey, scope)""")
def m05_standardise(spark, sf):
    """M5: features standardised per (entity, fit scope) with population std."""
    z = FE.standardise(FE.with_scopes(m04_holdout_split(spark, sf)), KEYS, FEATS)
    return rnd(z.select(*KEYS, "scope", "period", *[f"z_{f}" for f in FEATS]),
               [f"z_{f}" for f in FEATS])


@register("m06_ols", S.with_(OLS_SQL) + """
SELECT c_nationkey, period, target_model, round(predicted_model, 4) + 0.0 AS predicted_model FROM ins""")
def m06_ols(spark, sf):
    """M6: per-nation OLS (trend + lagged driver) fitted values of the growth
    target, solved from distributed sufficient statistics."""
    out = run(spark, sf, "ols")
    h = out["predictions"].where(F.col("kind") == "history")
    fr = out["frame"].select(*KEYS, "period", "target_model")
    return rnd(fr.join(h.select(*KEYS, "period", "predicted_model"), [*KEYS, "period"]),
               ["predicted_model"], 4)


@register("m10_fit_quality", S.with_(OLS_SQL, """
q AS (SELECT c_nationkey, 'in' AS split, COUNT(*) AS n, SUM((target_model - predicted_model) ** 2) AS ss,
             VAR_POP(target_model) * COUNT(*) AS st FROM ins GROUP BY 1
      UNION ALL
      SELECT c_nationkey, 'ho', COUNT(*), SUM((target_model - predicted_model) ** 2),
             VAR_POP(target_model) * COUNT(*) FROM hol GROUP BY 1),
m AS (SELECT c_nationkey, split, n, CASE WHEN n >= 2 AND st > 0 THEN 1 - ss / st END AS r2,
             sqrt(ss / n) AS rmse FROM q)""") + """
SELECT c_nationkey,
       MAX(CASE WHEN split = 'in' THEN n END) AS n,
       round(MAX(CASE WHEN split = 'in' THEN r2 END), 6) + 0.0 AS r2_in,
       round(MAX(CASE WHEN split = 'in' THEN rmse END), 6) + 0.0 AS rmse_in,
       round(MAX(CASE WHEN split = 'ho' THEN r2 END), 6) + 0.0 AS r2_holdout,
       round(MAX(CASE WHEN split = 'ho' THEN rmse END), 6) + 0.0 AS rmse_holdout,
       COALESCE(MAX(CASE WHEN split = 'ho' THEN n END), 0) AS n_holdout
FROM m GROUP BY 1""")
def m10_fit_quality(spark, sf):
    """In-sample and hold-out R^2 / RMSE on the transformed target."""
    m = run(spark, sf, "ols")["metrics"].select(*KEYS, "n", "r2_in", "rmse_in", "r2_holdout",
                                                "rmse_holdout", "n_holdout")
    return rnd(m, ["r2_in", "rmse_in", "r2_holdout", "rmse_holdout"])


@register("m11_fitted_levels", S.with_(OLS_SQL) + """
SELECT c_nationkey, period, target_level AS actual, """ + S.sig(
    "lag(target_level) OVER (PARTITION BY c_nationkey ORDER BY period) * (1 + predicted_model / 100.0)")
    + """ AS predicted FROM ins""")
def m11_fitted_levels(spark, sf):
    """Fitted levels rebuilt from the previous observed level."""
    h = run(spark, sf, "ols")["predictions"].where(F.col("kind") == "history")
    return sig(h.select(*KEYS, "period", "actual", "predicted"), ["predicted"])


LINES_SQL = f"""
tail AS (SELECT c_nationkey, period, order_count AS v FROM (
           SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY period DESC) AS rn
           FROM pb WHERE order_count IS NOT NULL AND period <= {CUT_SQL}) WHERE rn <= 10),
lines AS (SELECT c_nationkey, COUNT(*) AS n,
                 regr_slope(v, CAST(year(period) * 12 + month(period) - 1 AS DOUBLE)) AS slope,
                 regr_intercept(v, CAST(year(period) * 12 + month(period) - 1 AS DOUBLE)) AS intercept
          FROM tail GROUP BY 1 HAVING COUNT(*) >= 2)"""


@register("m12_driver_trend", S.with_(S.PB_WIDE, LINES_SQL) + """
SELECT c_nationkey, n, round(slope, 6) + 0.0 AS slope, round(intercept, 3) + 0.0 AS intercept FROM lines""")
def m12_driver_trend(spark, sf):
    """Local driver trend through the last <= 10 points up to the cut-off."""
    lines, _ = PR.driver_trend(pb_df(spark, sf), KEYS, "period", "order_count", CUT, "month", 10)
    return rnd(rnd(lines, ["slope"]), ["intercept"], 3)


GRID_SQL = f"""
grid AS (SELECT c_nationkey, CAST(s AS INTEGER) AS step,
                CAST({CUT_SQL} + to_months(CAST(s AS INTEGER)) AS DATE) AS period,
                CAST({CUT_SQL} + to_months(CAST(s - {LAG} AS INTEGER)) AS DATE) AS driver_period
         FROM (SELECT DISTINCT c_nationkey FROM pb), generate_series(1, {H}) AS g(s))"""


@register("m13_future_grid", S.with_(S.PB_WIDE, GRID_SQL) + "SELECT * FROM grid")
def m13_future_grid(spark, sf):
    """H future periods per entity with the lagged driver period."""
    return PR.future_grid(pb_df(spark, sf), KEYS, CUT, H, LAG, "month")


DRIVER_SQL = LINES_SQL + "," + GRID_SQL + f""",
drv AS (SELECT g.*, COALESCE(k.order_count, l.slope * CAST(year(g.driver_period) * 12 + month(g.driver_period) - 1 AS DOUBLE)
                              + l.intercept) AS order_count_lag1
        FROM grid g JOIN lines l USING (c_nationkey)
        LEFT JOIN (SELECT c_nationkey, period, order_count FROM pb
                   WHERE order_count IS NOT NULL AND period <= {CUT_SQL}) k
          ON k.c_nationkey = g.c_nationkey AND k.period = g.driver_period)"""


@register("j07_known_else_trend", S.with_(S.PB_WIDE, DRIVER_SQL) + """
SELECT c_nationkey, step, period, driver_period, round(order_count_lag1, 4) + 0.0 AS order_count_lag1 FROM drv""")
def j07_known_else_trend(spark, sf):
    """Future driver values: observed when known at or before the
    cut-off, else the local trend line."""
    pb = pb_df(spark, sf)
    lines, _ = PR.driver_trend(pb, KEYS, "period", "order_count", CUT, "month", 10)
    grid = PR.future_grid(pb, KEYS, CUT, H, LAG, "month")
    d = PR.known_else_trend(grid, pb, lines, KEYS, "period", "order_count", CUT, "month",
                            out="order_count_lag1",
                            earliest=add_periods(F.lit(CUT), 1 - LAG, "month"))
    return rnd(d, ["order_count_lag1"], 4)


PROJ_SQL = OLS_SQL + "," + DRIVER_SQL + f""",
t0 AS (SELECT c_nationkey, MIN(year(period) * 12 + month(period) - 1) AS t0 FROM pb
       WHERE period <= {CUT_SQL} GROUP BY 1),
last AS (SELECT c_nationkey, arg_max(order_value, period) AS last_level FROM pb
         WHERE order_value IS NOT NULL AND period <= {CUT_SQL} GROUP BY 1),
fut AS (SELECT d.c_nationkey, d.step, d.period,
               cf.b0 + cf.b1 * CAST(year(d.period) * 12 + month(d.period) - 1 - t0.t0 AS DOUBLE)
                 + cf.b2 * d.order_count_lag1 AS predicted_model
        FROM drv d JOIN t0 USING (c_nationkey) JOIN cf USING (c_nationkey)
        WHERE d.c_nationkey IN (SELECT c_nationkey FROM hs)),
proj AS (SELECT f.*, l.last_level * product(1 + predicted_model / 100.0)
                  OVER (PARTITION BY f.c_nationkey ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  AS predicted
         FROM fut f JOIN last l USING (c_nationkey))"""


@register("m14_recursive_projection", S.with_(PROJ_SQL) + """
SELECT c_nationkey, period, round(predicted_model, 4) + 0.0 AS predicted_model,
       """ + S.sig("predicted") + """ AS predicted FROM proj""")
def m14_recursive_projection(spark, sf):
    """Projected growth and levels rebuilt recursively from the last
    observed level."""
    p = run(spark, sf, "ols")["predictions"].where(F.col("kind") == "projection")
    return sig(rnd(p.select(*KEYS, "period", "predicted_model", "predicted"), ["predicted_model"], 4),
               ["predicted"])


@register("u01_history_projection", S.with_(PROJ_SQL) + """
SELECT c_nationkey, period, target_level AS actual, """ + S.sig(
    "lag(target_level) OVER (PARTITION BY c_nationkey ORDER BY period) * (1 + predicted_model / 100.0)")
    + """ AS predicted, 'history' AS kind FROM ins
UNION ALL
SELECT c_nationkey, period, CAST(NULL AS DOUBLE), """ + S.sig("predicted") + """, 'projection' FROM proj""")
def u01_history_projection(spark, sf):
    """History and projection rows appended into one prediction table."""
    p = run(spark, sf, "ols")["predictions"]
    return sig(p.select(*KEYS, "period", "actual", "predicted", "kind"), ["predicted"])


# The scoped and standardised frame with its time blocks, and the statistics of
# each fold's training rows (fold 0: all rows) and test rows.
FOLD_SQL = SPLIT_SQL + """,
sc AS (SELECT *, 'full' AS scope FROM hs UNION ALL SELECT *, 'train' FROM hs WHERE test_n > 0 AND NOT is_test),
zm AS (SELECT *, AVG(trend) OVER ws AS m1, AVG(order_count_lag1) OVER ws AS m2, STDDEV_POP(trend) OVER ws AS e1,
              STDDEV_POP(order_count_lag1) OVER ws AS e2, COUNT(*) OVER ws AS ns,
              row_number() OVER (PARTITION BY c_nationkey, scope ORDER BY period) - 1 AS rn
       FROM sc WINDOW ws AS (PARTITION BY c_nationkey, scope)),
zd AS (SELECT *, CASE WHEN e1 > 0 THEN e1 ELSE 1.0 END AS d1, CASE WHEN e2 > 0 THEN e2 ELSE 1.0 END AS d2,
              GREATEST(2, LEAST(5, ns // 5)) AS k FROM zm),
zk AS (SELECT *, (trend - m1) / d1 AS z1, (order_count_lag1 - m2) / d2 AS z2, target_model AS y,
              CASE WHEN ts <= 0 OR rn < ns - k * ts THEN 0 ELSE 1 + (rn - (ns - k * ts)) // ts END AS block
       FROM (SELECT *, ns // (k + 1) AS ts FROM zd)),
tr AS (SELECT c_nationkey, scope, f, CAST(COUNT(*) AS DOUBLE) AS n, AVG(z1) AS a1, AVG(z2) AS a2, AVG(y) AS ay,
              COVAR_POP(z1, z1) * COUNT(*) AS g11, COVAR_POP(z1, z2) * COUNT(*) AS g12, COVAR_POP(z2, z2) * COUNT(*) AS g22,
              COVAR_POP(z1, y) * COUNT(*) AS c1, COVAR_POP(z2, y) * COUNT(*) AS c2, VAR_POP(y) * COUNT(*) AS yy,
              MIN(m1) AS m1, MIN(m2) AS m2, MIN(d1) AS d1, MIN(d2) AS d2
       FROM zk JOIN generate_series(0, 5) AS g(f) ON f = 0 OR (f <= k AND block < f) GROUP BY 1, 2, 3),
te AS (SELECT c_nationkey, scope, block AS f, CAST(COUNT(*) AS DOUBLE) AS tn, SUM(z1) AS s1, SUM(z2) AS s2, SUM(y) AS sy, SUM(z1 * z1) AS s11,
              SUM(z1 * z2) AS s12, SUM(z2 * z2) AS s22, SUM(z1 * y) AS s1y, SUM(z2 * y) AS s2y, SUM(y * y) AS syy
       FROM zk WHERE block >= 1 GROUP BY 1, 2, 3)"""


def net_sql(name: str, src: str) -> str:
    """Elastic net of two features for each row of ``src`` (centred statistics,
    ``ratio``, ``alpha``): of the sign patterns, the one that meets the optimality
    conditions."""
    return f"""
{name}_l AS (SELECT *, n * alpha * ratio AS l1, g11 + n * alpha * (1 - ratio) AS h1, g22 + n * alpha * (1 - ratio) AS h2 FROM {src}),
{name}_p AS (SELECT *, CASE WHEN p1 = 0 THEN 0.0 WHEN p2 = 0 THEN (c1 - l1 * p1) / h1
                       ELSE ((c1 - l1 * p1) * h2 - g12 * (c2 - l1 * p2)) / (h1 * h2 - g12 * g12) END AS w1,
                CASE WHEN p2 = 0 THEN 0.0 WHEN p1 = 0 THEN (c2 - l1 * p2) / h2
                       ELSE ((c2 - l1 * p2) * h1 - g12 * (c1 - l1 * p1)) / (h1 * h2 - g12 * g12) END AS w2
          FROM {name}_l, (SELECT unnest([-1, 0, 1]) AS p1), (SELECT unnest([-1, 0, 1]) AS p2)),
{name} AS (SELECT *, ay - w1 * a1 - w2 * a2 AS b0 FROM {name}_p
  WHERE CASE WHEN p1 = 0 THEN abs(c1 - g12 * w2) <= l1 * (1 + 1e-12) + 1e-12 ELSE sign(w1) = p1 END
    AND CASE WHEN p2 = 0 THEN abs(c2 - g12 * w1) <= l1 * (1 + 1e-12) + 1e-12 ELSE sign(w2) = p2 END
  QUALIFY row_number() OVER (PARTITION BY c_nationkey, scope, f, ri, ai ORDER BY abs(p1) + abs(p2)) = 1)"""


NET_SQL = FOLD_SQL + """,
grid AS (SELECT ri, [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95][ri + 1]::DOUBLE AS ratio, ai, pow(10, -5 + 8.0 * (119 - ai) / 119) AS alpha
         FROM generate_series(0, 6) AS r(ri), generate_series(0, 119) AS a(ai)),
tried AS (SELECT tr.*, grid.* FROM tr, grid WHERE f > 0),""" + net_sql("net", "tried") + """,
err AS (SELECT c_nationkey, scope, ri, ai, ratio, alpha, AVG((syy - 2 * b0 * sy - 2 * (w1 * s1y + w2 * s2y) + tn * b0 * b0
               + 2 * b0 * (w1 * s1 + w2 * s2) + w1 * w1 * s11 + 2 * w1 * w2 * s12 + w2 * w2 * s22) / tn) AS mse
        FROM net JOIN te USING (c_nationkey, scope, f) GROUP BY ALL),
won AS (SELECT * FROM (SELECT *, MIN(mse) OVER (PARTITION BY c_nationkey, scope) AS least FROM err) WHERE mse <= least + 1e-9 * abs(least)
        QUALIFY row_number() OVER (PARTITION BY c_nationkey, scope ORDER BY ri, ai) = 1),
chosen AS (SELECT tr.*, won.ri, won.ai, won.ratio, won.alpha FROM tr JOIN won USING (c_nationkey, scope) WHERE f = 0),""" + net_sql("cf", "chosen")

# Evidence maximisation: one row per iteration; the last row of a fit has its precisions.
BAYES_SQL = FOLD_SQL + """,
fits AS (SELECT *, (g11 + g22) / 2 + sqrt(((g11 - g22) / 2) ** 2 + g12 ** 2) AS v1,
                GREATEST(0, (g11 + g22) / 2 - sqrt(((g11 - g22) / 2) ** 2 + g12 ** 2)) AS v2 FROM tr WHERE f = 0),
steps(c_nationkey, scope, it, a, l, w1, w2, met) AS (
  SELECT c_nationkey, scope, 0, 1 / (yy / n + 2.220446049250313e-16), 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, false FROM fits
  UNION ALL
  SELECT c_nationkey, scope, it + 1, (n - gamma + 2e-6) / (GREATEST(rss, 0) + 2e-6), (gamma + 2e-6) / (x1 * x1 + x2 * x2 + 2e-6), x1, x2,
         it > 0 AND abs(w1 - x1) + abs(w2 - x2) < 1e-3
  FROM (SELECT *, yy - 2 * (x1 * c1 + x2 * c2) + x1 * x1 * g11 + 2 * x1 * x2 * g12 + x2 * x2 * g22 AS rss,
               a * v1 / (l + a * v1) + a * v2 / (l + a * v2) AS gamma
        FROM (SELECT s.*, f.* EXCLUDE (c_nationkey, scope), ((g22 + l / a) * c1 - g12 * c2) / ((g11 + l / a) * (g22 + l / a) - g12 * g12) AS x1,
                     ((g11 + l / a) * c2 - g12 * c1) / ((g11 + l / a) * (g22 + l / a) - g12 * g12) AS x2
              FROM steps s JOIN fits f USING (c_nationkey, scope) WHERE NOT met AND it < 300))),
ends AS (SELECT f.*, s.a, s.l, s.met, (g11 + l / a) * (g22 + l / a) - g12 * g12 AS det
         FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY c_nationkey, scope ORDER BY it DESC) = 1) s
         JOIN fits f USING (c_nationkey, scope)),
cw AS (SELECT *, ((g22 + l / a) * c1 - g12 * c2) / det AS w1, ((g11 + l / a) * c2 - g12 * c1) / det AS w2,
              sqrt((g22 + l / a) / det / a) AS u1, sqrt((g11 + l / a) / det / a) AS u2 FROM ends),
cf AS (SELECT *, ay - w1 * a1 - w2 * a2 AS b0 FROM cw)"""

QUALITY = ["r2_in", "rmse_in", "r2_holdout", "rmse_holdout"]
QUALITY_SQL = """,
pr AS (SELECT hs.c_nationkey, scope, is_test, target_model, b0 + w1 * (trend - m1) / d1 + w2 * (order_count_lag1 - m2) / d2 AS p
       FROM hs JOIN cf USING (c_nationkey)),
ql AS (SELECT c_nationkey, scope, COUNT(*) AS n, SUM((target_model - p) ** 2) AS ss, VAR_POP(target_model) * COUNT(*) AS st
       FROM pr WHERE scope = 'full' OR is_test GROUP BY 1, 2),
qs AS (SELECT c_nationkey, scope, n, CASE WHEN n >= 2 AND st > 0 THEN 1 - ss / st END AS r2, sqrt(ss / n) AS rmse FROM ql),
qm AS (SELECT c_nationkey, MAX(CASE WHEN scope = 'full' THEN n END) AS n, round(MAX(CASE WHEN scope = 'full' THEN r2 END), 6) + 0.0 AS r2_in,
              round(MAX(CASE WHEN scope = 'full' THEN rmse END), 6) + 0.0 AS rmse_in,
              round(MAX(CASE WHEN scope = 'train' THEN r2 END), 6) + 0.0 AS r2_holdout,
              round(MAX(CASE WHEN scope = 'train' THEN rmse END), 6) + 0.0 AS rmse_holdout,
              COALESCE(MAX(CASE WHEN scope = 'train' THEN n END), 0) AS n_holdout FROM qs GROUP BY 1)"""


@register("m07_elastic_net", S.with_(NET_SQL) + QUALITY_SQL + f"""
SELECT qm.*, {S.sig("alpha")} AS alpha, ratio AS l1_ratio,
       CAST((abs(w1) <= 1e-8)::INTEGER + (abs(w2) <= 1e-8)::INTEGER AS INTEGER) AS n_zero_coef, true AS converged
FROM qm JOIN cf USING (c_nationkey) WHERE scope = 'full'""")
def m07_elastic_net(spark, sf):
    """M7: per-nation elastic net, (alpha, l1 ratio) chosen on expanding time
    folds from block statistics; metrics with the chosen parameters."""
    m = run(spark, sf, "elastic_net")["metrics"]
    m = m.select(*KEYS, "n", *QUALITY, "n_holdout", "alpha", "l1_ratio", "n_zero_coef", "converged")
    return sig(rnd(m, QUALITY), ["alpha"])


@register("m08_bayesian_ridge", S.with_(BAYES_SQL).replace("WITH", "WITH RECURSIVE", 1) + QUALITY_SQL + f"""
SELECT qm.*, {S.sig("a")} AS noise_precision, {S.sig("l")} AS weight_precision, met AS converged
FROM qm JOIN cf USING (c_nationkey) WHERE scope = 'full'""")
def m08_bayesian_ridge(spark, sf):
    """M8: per-nation Bayesian ridge; metrics with noise / weight precision."""
    m = run(spark, sf, "bayesian_ridge")["metrics"]
    m = m.select(*KEYS, "n", *QUALITY, "n_holdout", "noise_precision", "weight_precision", "converged")
    return sig(rnd(m, QUALITY), ["noise_precision", "weight_precision"])


@register("m09_gbt")
def m09_gbt(spark, sf):
    """M9: gradient boosting with the Huber loss, one booster per nation; fitted
    and projected levels of the growth target."""
    return run(spark, sf, "gbt")["predictions"]


@register("m09_gbt_modes")
def m09_gbt_modes(spark, sf):
    """M9: quality and details of the boosters of all three target modes."""
    modes = [run(spark, sf, "gbt", mode)["metrics"].drop("cutoff") for mode in FE.TARGET_MODES]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def importance_sql(first: str, second: str, rest: str = "") -> str:
    """Ranked rows of both features from columns of the fits."""
    return f""",
iw AS (SELECT c_nationkey, 'trend' AS feature, 0 AS i, {first} FROM cf WHERE scope = 'full'
       UNION ALL SELECT c_nationkey, 'order_count_lag1', 1, {second} FROM cf WHERE scope = 'full')
SELECT c_nationkey, feature, round(w, 5) + 0.0 AS std_coefficient{rest},
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(w) DESC, i) AS INTEGER) AS rank FROM iw"""


@register("m15_importance", S.with_(BAYES_SQL).replace("WITH", "WITH RECURSIVE", 1) + importance_sql("w1 AS w, u1 AS u", "w2, u2", ", round(u, 5) + 0.0 AS posterior_std"))
def m15_importance(spark, sf):
    """Standardised Bayesian-ridge coefficients with posterior std,
    ranked by |coefficient| per nation."""
    d = PR.importance(run(spark, sf, "bayesian_ridge")["coefficients"], KEYS, FEATS)
    return rnd(d.select(*KEYS, "feature", "std_coefficient", "posterior_std", "rank"), ["std_coefficient", "posterior_std"], 5)


@register("m15_importance_elastic_net", S.with_(NET_SQL) + importance_sql("w1 AS w", "w2", ", abs(w) <= 1e-8 AS is_zero"))
def m15_importance_elastic_net(spark, sf):
    """Standardised elastic-net coefficients and which are zero, ranked by
    |coefficient| per nation."""
    d = PR.importance(run(spark, sf, "elastic_net")["coefficients"], KEYS, FEATS)
    return rnd(d.select(*KEYS, "feature", "std_coefficient", "is_zero", "rank"), ["std_coefficient"], 5)


@register("m15_importance_gbt")
def m15_importance_gbt(spark, sf):
    """Share of the error that each feature's splits took away, over all trees
    of a nation's booster, ranked."""
    return PR.importance(run(spark, sf, "gbt")["coefficients"], KEYS, FEATS)


@register("m15_importance_ols", S.with_(OLS_SQL, """
iw AS (SELECT c_nationkey, 'trend' AS feature, 0 AS i, cf.b1 * sqrt(s11) AS w FROM cf JOIN cf_s USING (c_nationkey)
       UNION ALL SELECT c_nationkey, 'order_count_lag1', 1, cf.b2 * sqrt(s22) FROM cf JOIN cf_s USING (c_nationkey))""") + """
SELECT c_nationkey, feature, round(w, 5) + 0.0 AS std_coefficient,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(w) DESC, i) AS INTEGER) AS rank FROM iw""")
def m15_importance_ols(spark, sf):
    """Standardised OLS coefficients, ranked by |coefficient| per nation."""
    d = PR.importance(run(spark, sf, "ols")["coefficients"], KEYS, FEATS)
    return rnd(d.select(*KEYS, "feature", "std_coefficient", "rank"), ["std_coefficient"], 5)


IDX = "CAST(year({0}) * 12 + month({0}) - 1 AS DOUBLE)"
M16_SQL = S.PB_WIDE + f""",
lv AS (SELECT c_nationkey, period, order_value AS y, lag(order_count, 1) OVER (PARTITION BY c_nationkey ORDER BY period) AS x FROM pb),
lc AS (SELECT * FROM lv WHERE y IS NOT NULL AND x IS NOT NULL),
lt AS (SELECT *, {IDX.format("period")} - MIN({IDX.format("period")}) OVER w AS t, COUNT(*) OVER w AS n
       FROM lc WINDOW w AS (PARTITION BY c_nationkey)),
ls AS (SELECT c_nationkey, AVG(t) AS m1, AVG(x) AS m2, AVG(y) AS my, COVAR_POP(t, t) AS s11, COVAR_POP(t, x) AS s12,
              COVAR_POP(x, x) AS s22, COVAR_POP(t, y) AS s1y, COVAR_POP(x, y) AS s2y, MAX(period) AS stop,
              MIN({IDX.format("period")}) AS t0 FROM lt WHERE n >= 8 GROUP BY 1),
lb AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
              (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM ls),
dl AS (SELECT c_nationkey, regr_slope(order_count, {IDX.format("period")}) AS slope,
              regr_intercept(order_count, {IDX.format("period")}) AS icpt FROM pb WHERE order_count IS NOT NULL GROUP BY 1),
lp AS (SELECT lb.*, CAST(stop + to_months(CAST(s AS INTEGER)) AS DATE) AS period,
              CAST(stop + to_months(CAST(s - {LAG} AS INTEGER)) AS DATE) AS dp
       FROM lb, generate_series(1, {H}) AS g(s))"""


@register("m16_level_ols", S.with_(M16_SQL) + f"""
SELECT lt.c_nationkey, lt.period, y AS actual, round(my + b1 * (t - m1) + b2 * (x - m2), 3) + 0.0 AS predicted, 'history' AS kind
FROM lt JOIN lb USING (c_nationkey)
UNION ALL
SELECT lp.c_nationkey, period, CAST(NULL AS DOUBLE),
       round(my + b1 * ({IDX.format("period")} - t0 - m1) + b2 * (slope * {IDX.format("dp")} + icpt - m2), 3) + 0.0, 'projection'
FROM lp JOIN dl USING (c_nationkey)""")
def m16_level_ols(spark, sf):
    """Level OLS with a global trend per driver, raw features, projection
    after the last model period."""
    p = PL.level_ols(pb_df(spark, sf), KEYS, "period", "order_value", ["order_count"],
                     lag=LAG, horizon=H, freq="month")["predictions"]
    return rnd(p, ["predicted"], 3)
