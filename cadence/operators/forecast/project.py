"""Fit quality, fitted levels, driver extrapolation, future grid, recursive
projection and importance (M10-M15, J7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.forecast.features import every_entity
from cadence.operators.transforms import local_tail
from cadence.panel import add_periods, period_index, series_window

#: a standardised coefficient up to this size counts as zero
ZERO = 1e-8

def fit_quality(pred: DataFrame, keys: Sequence[str], y: str = "target_model",
                yhat: str = "predicted_model", split: str = "split") -> DataFrame:
    """R^2 = 1 - SSres/SStot and RMSE per (entity, split) on the
    transformed target; R^2 is NULL with fewer than 2 rows or SStot = 0."""
    g = pred.groupBy(*keys, split).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(y) - F.col(yhat)) ** 2).alias("ss_res"),
        F.var_pop(y).alias("_var"))
    ss_tot = F.col("_var") * F.col("n")
    return g.select(*keys, split, "n",
                    F.when((F.col("n") >= 2) & (ss_tot > 0),
                           1 - F.col("ss_res") / ss_tot).alias("r2"),
                    F.sqrt(F.col("ss_res") / F.col("n")).alias("rmse"))


def fitted_levels(pred: DataFrame, keys: Sequence[str], period: str, mode: str,
                  yhat: str = "predicted_model", level: str = "target_level") -> DataFrame:
    """Undo the target transform with the previous observed level of the
    model frame (first row of each entity has none)."""
    prev = F.lag(level, 1).over(series_window(keys, period))
    if mode == "growth":
        lv = prev * (1 + F.col(yhat) / 100.0)
    elif mode == "diff":
        lv = prev + F.col(yhat)
    else:
        lv = F.col(yhat)
    return pred.withColumn("predicted", lv)


def driver_trend(df: DataFrame, keys: Sequence[str], period: str, driver: str, cutoff, freq: str,
                 window: int | None = 10, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Straight line through the last ``window`` observed points at or
    before the cut-off (all points when ``window`` is None).  Returns
    (trend lines (keys, slope, intercept, n), rejections for < 2 points).
    ``entities`` are those a line is wanted for: one without any point is
    rejected with n = 0, and others get neither line nor rejection."""
    d = df.select(*keys, period, F.col(driver).alias("v"))
    if window is None:
        d = d.where(F.col("v").isNotNull() & (F.col(period) <= F.lit(cutoff)))
    else:
        d = local_tail(d, keys, period, "v", cutoff, window)
    t = period_index(period, freq).cast("double")
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", t).alias("slope"),
                             F.regr_intercept("v", t).alias("intercept"))
    if entities is not None:
        g = every_entity(entities, keys, g).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    ok = g.where(F.col("n") >= 2)
    rej = (g.where(F.col("n") < 2).select(*keys, "n")
           .withColumn("reason", F.lit(f"cannot extrapolate {driver}: fewer than 2 points")))
    return ok, rej


def known_else_trend(requests: DataFrame, df: DataFrame, lines: DataFrame, keys: Sequence[str],
                     period: str, driver: str, cutoff, freq: str, req: str = "driver_period",
                     out: str = "driver_value", earliest=None) -> DataFrame:
    """The observed value when the requested period is at or before the
    cut-off and observed, else slope * t + intercept.  ``earliest`` (the
    first period any request can ask for) limits the lookup side to the few
    periods that can match, instead of shuffling the whole panel."""
    cond = F.col(driver).isNotNull() & (F.col(period) <= F.lit(cutoff))
    if earliest is not None:
        cond = cond & (F.col(period) >= F.lit(earliest))
    known = df.where(cond).select(*keys, F.col(period).alias(req), F.col(driver).alias("_known"))
    j = requests.join(known, [*keys, req], "left").join(lines.select(*keys, "slope", "intercept"),
                                                        list(keys), "inner")
    est = F.col("slope") * period_index(req, freq).cast("double") + F.col("intercept")
    return j.withColumn(out, F.coalesce(F.col("_known"), est)).drop("_known", "slope", "intercept")


def future_grid(entities: DataFrame, keys: Sequence[str], cutoff, horizon: int, lag: int,
                freq: str, period: str = "period") -> DataFrame:
    """H future periods after the cut-off per entity, with the lagged
    driver period (future - lag)."""
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    g = entities.select(*keys).distinct().select(*keys, step)
    return g.withColumns({period: add_periods(F.lit(cutoff), F.col("step"), freq),
                          "driver_period": add_periods(F.lit(cutoff), F.col("step") - lag, freq)})


def recursive_levels(future: DataFrame, last_level: DataFrame, keys: Sequence[str], mode: str,
                     yhat: str = "predicted_model", step: str = "step") -> DataFrame:
    """Rebuild levels from the last observed level: growth multiplies by
    (1 + g/100), diff adds, level passes through.  A running product or sum over
    the entity's steps, so the work is linear in the horizon (not exp(sum(log)),
    which breaks for g <= -100)."""
    if mode == "level":
        return future.withColumn("predicted", F.col(yhat))
    so_far = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("last_level")
    level = last * F.product(1 + F.col(yhat) / 100.0).over(so_far) if mode == "growth" else last + F.sum(yhat).over(so_far)
    joined = future.join(last_level.select(*keys, "last_level"), list(keys), "inner")
    return joined.withColumn("predicted", level).drop("last_level")


def last_observed(df: DataFrame, keys: Sequence[str], period: str, value: str, cutoff) -> DataFrame:
    """Last non-NULL level at or before the cut-off, per entity."""
    d = df.where(F.col(value).isNotNull() & (F.col(period) <= F.lit(cutoff)))
    return d.groupBy(*keys).agg(F.max_by(value, period).alias("last_level"))


def importance(coefs: DataFrame, keys: Sequence[str], features: Sequence[str],
               scope: str = "full") -> DataFrame:
    """One row per (entity, feature), ranked.  Linear models: the standardised
    coefficient (and posterior std when the model has one) by its absolute value,
    and whether it is zero.  Boosters: the share of the error that the feature's
    splits took away, over all trees."""
    c = coefs.where(F.col("scope") == scope)
    names = F.array(*[F.lit(f) for f in features])
    if "importance" in coefs.columns:
        d = c.select(*keys, F.posexplode("importance").alias("i", "importance"))
        size = F.col("importance")
    else:
        d = c.select(*keys, F.posexplode("coef").alias("i", "std_coefficient"), "posterior_std")
        d = d.withColumns({"posterior_std": F.col("posterior_std")[F.col("i")],
                           "is_zero": F.abs("std_coefficient") <= ZERO})
        size = F.abs("std_coefficient")
    w = Window.partitionBy(*keys).orderBy(size.desc(), F.col("i"))
    return d.withColumns({"feature": names[F.col("i")], "rank": F.row_number().over(w)}).drop("i")
