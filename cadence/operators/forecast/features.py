"""Feature frame, target modes, support guard, temporal hold-out and
standardisation (M1-M5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.transforms import pct_change_expr
from cadence.panel import period_index, series_window, whole_series

TARGET_MODES = ("growth", "diff", "level")
TREND = "trend"


def target_transform(value: str, mode: str, w) -> Column:
    """M2: growth % (gap-preserving), absolute difference, or the level."""
    v = F.col(value)
    if mode == "growth":
        return pct_change_expr(value, w)
    if mode == "diff":
        return v - F.lag(v, 1).over(w)
    if mode == "level":
        return v
    raise ValueError(f"unknown target mode {mode!r}")


def feature_names(predictors: Sequence[str], lag: int) -> list[str]:
    return [TREND] + [f"{p}_lag{lag}" for p in predictors]


def feature_frame(df: DataFrame, keys: Sequence[str], period: str, target: str,
                  predictors: Sequence[str], lag: int, mode: str, cutoff, freq: str) -> DataFrame:
    """M1: rows up to the cut-off, transformed target, predictors shifted
    ``lag`` rows (positional), trend = periods since the entity's first
    period, then complete cases.  Output: keys, period, target_level,
    target_model, features..."""
    w = series_window(keys, period)
    d = df.where(F.col(period) <= F.lit(cutoff)).select(
        *keys, period, F.col(target).cast("double").alias("target_level"),
        *[F.col(p).cast("double").alias(p) for p in predictors])
    idx = period_index(period, freq)
    cols = {"target_model": target_transform("target_level", mode, w),
            TREND: (idx - F.min(idx).over(whole_series(keys))).cast("double")}
    for p in predictors:
        cols[f"{p}_lag{lag}"] = F.lag(p, lag).over(w) if lag >= 0 else F.lead(p, -lag).over(w)
    feats = feature_names(predictors, lag)
    d = d.withColumns(cols).select(*keys, period, "target_level", "target_model", *feats)
    return d.na.drop("any", subset=["target_level", "target_model", *feats])


def minimum_support(n_features: int, floor: int = 10, extra: int = 5) -> int:
    """M3: n >= max(floor, features + extra)."""
    return max(floor, n_features + extra)


def support_split(frame: DataFrame, keys: Sequence[str], minimum: int,
                  entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M3: (kept rows, rejections (keys, reason, n)).  ``entities`` lists all
    entities of the input, so that one without any complete row is rejected
    with n = 0; without it only the frame's own entities are known."""
    kept = frame.withColumn("n", F.count(F.lit(1)).over(whole_series(keys))).where(F.col("n") >= minimum)
    counts = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if entities is not None:
        counts = every_entity(entities, keys, counts)
    rejected = counts.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(F.col("n") < minimum)
    return kept, rejected.select(*keys, F.lit(f"fewer than {minimum} complete observations").alias("reason"), "n")


def every_entity(entities: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """``found`` (one row per entity) for every distinct entity, NULL-safe."""
    e = entities.select(*[F.col(k).alias(f"_e_{k}") for k in keys]).distinct()
    on = [F.col(f"_e_{k}").eqNullSafe(F.col(k)) for k in keys]
    rest = [c for c in found.columns if c not in keys]
    return e.join(found, on, "left").select(*[F.col(f"_e_{k}").alias(k) for k in keys], *rest)


def holdout_split(frame: DataFrame, keys: Sequence[str], period: str, n_features: int) -> DataFrame:
    """M4: the last max(3, round(0.2 n)) rows, capped at n - max(6, p + 2),
    are the temporal hold-out; no hold-out when that leaves fewer than 2."""
    n = F.count(F.lit(1)).over(whole_series(keys))
    test_n = F.least(F.greatest(F.lit(3), F.round(n * 0.2).cast("bigint")),
                     n - F.lit(max(6, n_features + 2)))
    test_n = F.when(test_n >= 2, test_n).otherwise(F.lit(0))
    rn_desc = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(period).desc()))
    d = frame.withColumns({"n": n, "test_n": test_n.cast("bigint")})
    return d.withColumn("is_test", rn_desc <= F.col("test_n"))


def with_scopes(frame: DataFrame) -> DataFrame:
    """Each row belongs to the 'full' fit and, when it is a training row of a
    valid hold-out split, also to the 'train' fit."""
    scopes = F.when((F.col("test_n") > 0) & ~F.col("is_test"), F.array(F.lit("full"), F.lit("train"))) \
        .otherwise(F.array(F.lit("full")))
    return frame.withColumn("scope", F.explode(scopes))


def standardise(scoped: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """M5: z = (x - mean) / population std over each (entity, scope); a
    constant feature keeps scale 1.  Mean/std columns are kept (mu_*, sd_*)."""
    ws = Window.partitionBy(*keys, "scope")
    cols = {}
    for f in features:
        mu, sd = F.avg(f).over(ws), F.stddev_pop(f).over(ws)
        cols[f"mu_{f}"] = mu
        cols[f"sd_{f}"] = F.when(sd > 0, sd).otherwise(F.lit(1.0))
    d = scoped.withColumns(cols)
    return d.withColumns({f"z_{f}": (F.col(f) - F.col(f"mu_{f}")) / F.col(f"sd_{f}") for f in features})


def time_blocks(z: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Expanding-window fold layout inside each (entity, scope): k =
    max(2, min(5, n // 5)) test blocks of n // (k + 1) rows at the end,
    block 0 holds the earlier rows.  Fold i trains on blocks < i and tests on
    block i."""
    ws = Window.partitionBy(*keys, "scope")
    rn = F.row_number().over(ws.orderBy(period)) - 1
    ns = F.count(F.lit(1)).over(ws)
    k = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(ns / 5)))
    ts = F.floor(ns / (k + 1))
    first = ns - k * ts
    block = F.when((ts <= 0) | (rn < first), F.lit(0)).otherwise(1 + F.floor((rn - first) / ts))
    return z.withColumns({"n_scope": ns, "k_folds": k.cast("int"), "block": block.cast("int")})
