"""``fit_predict``: the whole forecasting job for every entity of a panel.

Steps (the input, the model frame and the coefficients are checkpointed while
the plan is built, the outputs are lazy):
  feature frame (M1, M2) -> support guard (M3) -> temporal hold-out (M4)
  -> per-scope standardisation (M5) -> block statistics -> per-entity fit
  (M6-M9) -> fit quality (M10) -> fitted levels (M11)
  -> driver extrapolation (M12, J7) -> future grid (M13) -> recursive levels
  (M14) -> history + projection union (U1) -> importance (M15).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.forecast import boost as B
from cadence.operators.forecast import features as FE
from cadence.operators.forecast import gram as G
from cadence.operators.forecast import project as PR
from cadence.operators.quality import require_columns
from cadence.panel import add_periods, period_index

MODELS = ("ols", "elastic_net", "bayesian_ridge", "gbt")


def _future_features(df, keys, period, predictors, lag, horizon, cutoff, freq, entities,
                     driver_window=10, trend_base=None):
    grid = PR.future_grid(entities, keys, cutoff, horizon, lag, freq, period)
    rejections = []
    for p in predictors:
        lines, rej = PR.driver_trend(df, keys, period, p, cutoff, freq, driver_window, entities)
        grid = PR.known_else_trend(grid, df, lines, keys, period, p, cutoff, freq,
                                   out=f"{p}_lag{lag}",
                                   earliest=add_periods(F.lit(cutoff), 1 - lag, freq))
        rejections.append(rej)
    if trend_base is None:
        trend_base = (df.where(F.col(period) <= F.lit(cutoff)).groupBy(*keys)
                      .agg(F.min(period_index(period, freq)).alias("_t0")))
    grid = grid.join(trend_base, list(keys), "inner").withColumn(
        FE.TREND, (period_index(period, freq) - F.col("_t0")).cast("double")).drop("_t0")
    return grid, rejections


def _materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``: cuts the
    lineage (a lost executor does not replay the panel build) and computes
    the frame/fit once for all the outputs that reuse it.  The key
    partitioning of the checkpointed plan is kept."""
    from cadence.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fit_predict(df: DataFrame, keys: Sequence[str], period: str, target: str,
                predictors: Sequence[str], model: str = "ols", lag: int = 1, horizon: int = 5,
                mode: str = "growth", cutoff=None, freq: str = "month",
                materialise: bool = True) -> dict[str, DataFrame]:
    """Fit one model per entity and project ``horizon`` periods past ``cutoff``.  Returns DataFrames: predictions (keys, period,
    actual, predicted, kind), metrics, coefficients, rejections, holdout.

    With ``materialise`` the model frame and the coefficient table (one row
    per entity and scope) are checkpointed once; every output reuses them."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    keys = list(keys)
    require_columns(df, [*keys, period, target, *predictors], "forecast input")
    feats = FE.feature_names(predictors, lag)
    df = df.select(*keys, period, target, *predictors)
    if materialise:
        # the panel feeds the entity list, the frame, the driver trends, the
        # known-value lookup and the last observed level: compute it once
        df = _materialise(df)
    every = df.select(*keys).distinct()
    # past the cut-off, only the entities' names are used
    df = df.where(F.col(period) <= F.lit(cutoff))
    frame = FE.feature_frame(df, keys, period, target, predictors, lag, mode, cutoff, freq)
    kept, rej_support = FE.support_split(frame, keys, FE.minimum_support(len(feats)), every)
    split = FE.holdout_split(kept, keys, period, len(feats))
    if materialise:
        split = _materialise(split)

    scoped = FE.with_scopes(split)
    if model == "gbt":
        coefs, value = B.fit(scoped, keys, feats, period), B.predict_expr(feats)
    else:
        z = FE.time_blocks(FE.standardise(scoped, keys, feats), keys, period)
        coefs, value = G.fit(G.block_stats(z, keys, feats), keys, model), G.predict_expr(feats)
    if materialise:
        coefs = _materialise(coefs)
    full = coefs.where(F.col("scope") == "full").drop("scope", "n")
    train = coefs.where(F.col("scope") == "train").drop("scope", "n")
    in_sample = split.join(full, keys, "inner").withColumn("predicted_model", value)
    holdout = split.where(F.col("is_test")).join(train, keys, "inner").withColumn("predicted_model", value)

    q = PR.fit_quality(in_sample.withColumn("split", F.lit("in_sample")).select(
        *keys, "split", "target_model", "predicted_model").unionByName(
        holdout.withColumn("split", F.lit("holdout")).select(
            *keys, "split", "target_model", "predicted_model")), keys)
    metrics = q.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "in_sample", F.col("r2"))).alias("r2_in"),
        F.max(F.when(F.col("split") == "in_sample", F.col("rmse"))).alias("rmse_in"),
        F.max(F.when(F.col("split") == "in_sample", F.col("n"))).alias("n"),
        F.max(F.when(F.col("split") == "holdout", F.col("r2"))).alias("r2_holdout"),
        F.max(F.when(F.col("split") == "holdout", F.col("rmse"))).alias("rmse_holdout"),
        F.coalesce(F.max(F.when(F.col("split") == "holdout", F.col("n"))), F.lit(0)).alias("n_holdout"))
    metrics = metrics.withColumns({"cutoff": F.lit(cutoff), "target_mode": F.lit(mode),
                                   "model": F.lit(model)})
    if model == "gbt":
        metrics = metrics.withColumns(B.details())
    else:
        extra = coefs.where(F.col("scope") == "full").select(
            *keys, "alpha", "l1_ratio", "n_zero_coef", "noise_precision", "weight_precision", "converged")
        metrics = metrics.join(extra, keys, "left")

    history = PR.fitted_levels(in_sample, keys, period, mode).select(
        *keys, period, F.col("target_level").alias("actual"), "predicted", "predicted_model",
        F.lit("history").alias("kind"))

    entities = split.select(*keys).distinct()
    grid, rej_drivers = _future_features(df, keys, period, predictors, lag, horizon, cutoff, freq,
                                         entities)
    fut = grid.join(full, keys, "inner").withColumn("predicted_model", value)
    last = PR.last_observed(df, keys, period, target, cutoff)
    proj = PR.recursive_levels(fut, last, keys, mode).select(
        *keys, period, F.lit(None).cast("double").alias("actual"), "predicted", "predicted_model",
        F.lit("projection").alias("kind"))

    rejections = rej_support
    for r in rej_drivers:
        rejections = rejections.unionByName(r.select(*keys, "reason", "n"))
    return {"predictions": history.unionByName(proj), "metrics": metrics, "coefficients": coefs,
            "rejections": rejections, "holdout": holdout, "frame": split}


def level_ols(df: DataFrame, keys: Sequence[str], period: str, target: str,
              predictors: Sequence[str], lag: int = 1, horizon: int = 5,
              freq: str = "month") -> dict[str, DataFrame]:
    """Level OLS with a trend and lagged drivers, no cut-off, n >=
    max(8, predictors + 4); coefficients are those of the raw drivers (solved
    on standardised ones and mapped back); drivers are extrapolated with one straight
    line through all their points; projection starts after the last model
    period."""
    from cadence.panel import series_window, whole_series
    keys = list(keys)
    require_columns(df, [*keys, period, target, *predictors], "forecast input")
    w = series_window(keys, period)
    lagged = {f"{p}_lag{lag}": F.lag(p, lag).over(w) for p in predictors}
    d = df.select(*keys, period, F.col(target).cast("double").alias("target_level"),
                  *[F.col(p).cast("double").alias(p) for p in predictors]).withColumns(lagged)
    feats_raw = list(lagged)
    d = d.na.drop("any", subset=["target_level", *feats_raw])
    idx = period_index(period, freq)
    d = d.withColumns({"t0": F.min(idx).over(whole_series(keys)),
                       "last_period": F.max(period).over(whole_series(keys))})
    d = d.withColumn(FE.TREND, (idx - F.col("t0")).cast("double"))
    feats = [FE.TREND, *feats_raw]
    kept, rej = FE.support_split(d.withColumn("target_model", F.col("target_level")), keys,
                                 max(8, len(predictors) + 4), df)
    kept = _materialise(kept)
    # cross-products of standardised features: raw ones of very different size
    # (a trend beside a driver of 1e13) would drown each other
    z = FE.standardise(kept.withColumn("scope", F.lit("full")), keys, feats)
    z = z.withColumns({"block": F.lit(0), "k_folds": F.lit(0)})
    scaled = _materialise(G.fit(G.block_stats(z, keys, feats), keys, "ols"))
    c = scaled.drop("scope", "n")
    coefs = G.unscaled(scaled)
    fitted = kept.join(c, keys, "inner").withColumn("predicted", G.predict_expr(feats))
    q = PR.fit_quality(fitted.withColumn("split", F.lit("in_sample")), keys,
                       yhat="predicted")
    metrics = q.select(*keys, "r2", "rmse", "n").withColumn("equation_terms",
                                                           F.lit(len(feats) + 1))
    ends = kept.groupBy(*keys).agg(F.max(period).alias("_end"), F.first("t0").alias("_t0"))
    from cadence.panel import add_periods
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    grid = ends.select(*keys, "_end", "_t0", step).withColumns({
        period: add_periods(F.col("_end"), F.col("step"), freq),
        "driver_period": add_periods(F.col("_end"), F.col("step") - lag, freq)})
    grid = grid.withColumn(FE.TREND, (period_index(period, freq) - F.col("_t0")).cast("double"))
    for p in predictors:
        lines, r = PR.driver_trend(df, keys, period, p, F.lit("9999-12-31").cast("date")
                                   if freq != "year" else 9999, freq, None, ends)
        grid = grid.join(lines.select(*keys, "slope", "intercept"), keys, "inner").withColumn(
            f"{p}_lag{lag}", F.col("slope") * period_index("driver_period", freq).cast("double")
            + F.col("intercept")).drop("slope", "intercept")
        rej = rej.unionByName(r.select(*keys, "reason", "n"))
    proj = grid.join(c, keys, "inner").withColumn("predicted", G.predict_expr(feats))
    preds = fitted.select(*keys, period, F.col("target_level").alias("actual"), "predicted",
                          F.lit("history").alias("kind")).unionByName(
        proj.select(*keys, period, F.lit(None).cast("double").alias("actual"), "predicted",
                    F.lit("projection").alias("kind")))
    return {"predictions": preds, "metrics": metrics, "coefficients": coefs, "rejections": rej}
