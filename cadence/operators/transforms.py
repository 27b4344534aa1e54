"""Series transforms.

All windows are ``partitionBy(keys)`` — in a long panel ``keys`` includes the
``metric`` column — so each series is one window partition whose length is the
number of periods, independent of how many raw rows were aggregated into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.exprs import finite, log10_pos, safe_div
from cadence.panel import series_window, whole_series

# The transform names offered by the series transform.
TRANSFORMS = ("original", "base100", "log10", "log10_base100", "pct_change",
              "cum_change", "zscore")

# Axis labels for each transform (the "original" label is
# the scaled unit from ``display_scale``).
AXIS_LABELS = {
    "base100": "Index base 100",
    "log10": "Log10(value)",
    "log10_base100": "Log10(index base 100)",
    "pct_change": "Period change (%)",
    "cum_change": "Cumulative change (%)",
    "zscore": "Z-score",
}


def shift(df: DataFrame, keys: Sequence[str], period: str, value: str, k: int,
          out: str | None = None) -> DataFrame:
    """Positional shift by ``k`` rows (k < 0 reads ahead)."""
    w = series_window(keys, period)
    col = F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w)
    return df.withColumn(out or f"{value}_shift{k}", col)


def pct_change_expr(value: str | Column, w) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return (safe_div(v, F.lag(v, 1).over(w)) - 1) * 100


def pct_change(df: DataFrame, keys: Sequence[str], period: str, value: str,
               out: str = "pct_change", skip_gaps: bool = False) -> DataFrame:
    """W2a (``skip_gaps``): NULL rows are dropped first, so the change is
    against the previous *available* value.  W2b: a NULL neighbour yields NULL."""
    if skip_gaps:
        df = df.where(F.col(value).isNotNull())
    return df.withColumn(out, pct_change_expr(value, series_window(keys, period)))


def diff(df: DataFrame, keys: Sequence[str], period: str, value: str,
         out: str = "diff") -> DataFrame:
    """Absolute difference to the previous row."""
    return df.withColumn(out, F.col(value) - F.lag(value, 1).over(series_window(keys, period)))


def _base_struct(period: str, value: str, base_period) -> Column:
    """min_by aggregate of a series: the requested period if non-zero, else the
    first later non-zero, else the earliest non-zero.  NULL and zero values
    get a NULL ordering key and are never chosen."""
    v, p = F.col(value), F.col(period)
    order = F.when(v.isNotNull() & (v != 0),
                   F.struct((p < F.lit(base_period)).cast("int").alias("after"), p.alias("p")))
    return F.min_by(F.struct(v.alias("v"), p.alias("p")), order)


def base_value(df: DataFrame, keys: Sequence[str], period: str, value: str, base_period,
               out_value: str = "base_value", out_period: str = "base_period") -> DataFrame:
    """Base value and the period it was taken from, per series."""
    b = _base_struct(period, value, base_period).over(whole_series(keys))
    return df.withColumn("_base", b).withColumns(
        {out_value: F.col("_base.v"), out_period: F.col("_base.p")}).drop("_base")


def base_values(df: DataFrame, keys: Sequence[str], period: str, value: str, base_period) -> DataFrame:
    """W4 as one row per series: keys, base_value, base_period."""
    b = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(_base_struct(period, value, base_period).alias("_b"))
    return b.select(*keys, F.col("_b.v").alias("base_value"), F.col("_b.p").alias("base_period"))


def real_terms(df: DataFrame, keys: Sequence[str], metric: str, real_of: dict[str, str]) -> DataFrame:
    """Each metric in real terms.  ``real_of`` maps a metric to the one
    that holds its real version; where an entity (``keys``) has that, its rows
    stand for the metric (``used_real``), otherwise the original rows stay and
    ``warning`` says so.  The real versions are not listed by themselves."""
    back = F.create_map(*[F.lit(x) for m, r in real_of.items() for x in (r, m)]) if real_of else None
    label = F.coalesce(back[F.col(metric)], F.col(metric)) if real_of else F.col(metric)
    d = df.withColumns({"used_real": F.col(metric).isin(list(real_of.values())), "_label": label})
    there = F.max("used_real").over(Window.partitionBy(*keys, "_label"))
    d = d.withColumn("_there", there).where(F.col("used_real") == F.col("_there"))
    warning = F.when(~F.col("used_real"), F.concat(F.col("_label"), F.lit(": no real version, original kept")))
    return d.withColumns({metric: F.col("_label"), "warning": warning}).drop("_label", "_there")


def display_scale(value: Column, unit: Column, keys: Sequence[str]) -> tuple[Column, Column, Column]:
    """(scaled value, label, factor), the magnitude per series from
    max|x|.  Rule order: percent / exchange-rate / index units first, then
    persons, then money units."""
    max_abs = F.max(F.abs(value)).over(whole_series(keys))
    u = F.coalesce(unit, F.lit(""))
    plain = u.contains("%") | u.contains("MXN/USD") | F.lower(u).contains("index")
    persons = F.lower(u) == "persons"
    money = u.contains("USD") | u.contains("MXN")
    factor = (F.when(max_abs.isNull() | plain, F.lit(1.0))
              .when(persons, F.lit(1e6))
              .when(money & (max_abs >= 1e12), F.lit(1e12))
              .when(money & (max_abs >= 1e9), F.lit(1e9))
              .when(money & (max_abs >= 1e6), F.lit(1e6))
              .otherwise(F.lit(1.0)))
    label = (F.when(max_abs.isNull() | plain, u)
             .when(persons, F.lit("millions of persons"))
             .when(money & (max_abs >= 1e12), F.concat(F.lit("trillions "), u))
             .when(money & (max_abs >= 1e9), F.concat(F.lit("billions "), u))
             .when(money & (max_abs >= 1e6), F.concat(F.lit("millions "), u))
             .otherwise(u))
    return value / factor, label, factor


def transform_series(df: DataFrame, keys: Sequence[str], period: str = "period",
                     value: str = "value", kind: str = "base100", base_period=None,
                     unit: str | None = None, min_points: int = 2) -> DataFrame:
    """One call transforms every series of a long panel.

    NULL values are dropped first, series with fewer than ``min_points``
    points are omitted, the transform is applied, and NULL/non-finite results
    are dropped.  Output: keys..., period, original, transformed, axis_label,
    base_period.
    """
    return transform_kinds(df, keys, [kind], period, value, base_period, unit, min_points).drop("kind")


def transform_kinds(df: DataFrame, keys: Sequence[str], kinds: Sequence[str], period: str = "period", value: str = "value",
                    base_period=None, unit: str | None = None, min_points: int = 2) -> DataFrame:
    """Several transforms of every series, with a ``kind`` column: the panel is
    read and dealt out by series once, whatever the number of kinds."""
    if unknown := set(kinds) - set(TRANSFORMS):
        raise ValueError(f"unknown transforms {sorted(unknown)}")
    unit_col = F.col(unit) if unit else F.lit(None).cast("string")
    d = (df.where(F.col(value).isNotNull() & F.col(period).isNotNull())
         .select(*keys, period, F.col(value).alias("original"), unit_col.alias("_unit")))
    d = d.withColumn("_n", F.count("*").over(whole_series(keys))).where(F.col("_n") >= min_points)
    o, ws = F.col("original"), whole_series(keys)
    no_base = F.lit(None).cast(d.schema[period].dataType)
    if {"base100", "log10_base100", "cum_change"} & set(kinds):
        d = d.withColumn("_b", _base_struct(period, "original", base_period).over(ws))
    base = F.col("_b.v")
    made, rows = {}, []
    for i, kind in enumerate(kinds):
        label, at = F.lit(AXIS_LABELS.get(kind)).cast("string"), no_base
        if kind in ("base100", "log10_base100", "cum_change"):
            t = {"base100": o / base * 100, "log10_base100": log10_pos(o / base * 100), "cum_change": (o / base - 1) * 100}[kind]
            at = F.col("_b.p")
        elif kind == "original":
            t, label, _ = display_scale(o, F.col("_unit"), keys)
        elif kind == "log10":
            t = log10_pos(o)
        elif kind == "pct_change":
            t = pct_change_expr("original", series_window(keys, period))
        else:  # zscore, population std; a constant series is omitted
            sd = F.stddev_pop(o).over(ws)
            t = F.when(sd > 0, (o - F.avg(o).over(ws)) / sd)
        made |= {f"_t{i}": finite(t), f"_l{i}": label}
        rows.append(F.struct(F.lit(kind).alias("kind"), F.col(f"_t{i}").alias("transformed"), F.col(f"_l{i}").alias("axis_label"), at.alias("base_period")))
    out = d.withColumns(made).select(*keys, period, "original", F.inline(F.array(*rows)))
    return out.where(F.col("transformed").isNotNull()).select(*keys, period, "original", "transformed", "axis_label", "base_period", "kind")


def zscore(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None,
           zero_when_constant: bool = False) -> DataFrame:
    """W9 on one column: (v - mean) / population std over the series."""
    ws = whole_series(keys)
    v = F.col(value)
    sd = F.stddev_pop(v).over(ws)
    z = F.when(sd > 0, (v - F.avg(v).over(ws)) / sd)
    if zero_when_constant:
        z = F.when(v.isNotNull(), F.coalesce(z, F.lit(0.0)))
    return df.withColumn(out or f"{value}_z", z)


def shares(df: DataFrame, keys: Sequence[str], period: str, total: str, parts: Sequence[str],
           min_rows: int = 2) -> DataFrame:
    """Composition shares part/total*100 on complete cases; series with
    fewer than ``min_rows`` complete rows are omitted."""
    cols = [total, *parts]
    d = df.select(*keys, period, *cols).na.drop("any", subset=cols)
    d = d.withColumn("_n", F.count("*").over(whole_series(keys))).where(F.col("_n") >= min_rows)
    return d.select(*keys, period, *[(safe_div(F.col(p), F.col(total)) * 100).alias(f"{p}_share")
                                     for p in parts])


def elasticity(df: DataFrame, keys: Sequence[str], period: str, target: str, driver: str,
               threshold: float = 0.1) -> DataFrame:
    """Joint complete cases, gap-skipping % changes of both series, and
    their ratio; NULL (dropped) when |driver change| < threshold."""
    d = df.select(*keys, period, target, driver).na.drop("any", subset=[target, driver])
    w = series_window(keys, period)
    d = d.withColumns({"target_pct": pct_change_expr(target, w),
                       "driver_pct": pct_change_expr(driver, w)})
    e = safe_div(F.col("target_pct"), F.when(F.abs("driver_pct") >= threshold, F.col("driver_pct")))
    return d.withColumn("elasticity", finite(e)).where(F.col("elasticity").isNotNull())


def lag_pair(df: DataFrame, keys: Sequence[str], period: str, target: str, driver: str,
             lag: int, use_changes: bool) -> DataFrame:
    """(period, target, driver lagged ``lag`` rows) on levels or
    gap-preserving changes, complete cases, each standardised over the pair
    rows (0 when constant), and the ``correlation`` of the series' pairs (NULL
    when either side is constant)."""
    w = series_window(keys, period)
    t = pct_change_expr(target, w) if use_changes else F.col(target)
    d = df.select(*keys, period, t.alias("target"),
                  (pct_change_expr(driver, w) if use_changes else F.col(driver)).alias("driver"))
    d = d.withColumn("driver_lagged",
                     F.lag("driver", lag).over(w) if lag >= 0 else F.lead("driver", -lag).over(w))
    d = d.select(*keys, period, "target", "driver_lagged").na.drop("any",
                                                                subset=["target", "driver_lagged"])
    d = zscore(d, keys, "target", "target_z", zero_when_constant=True)
    d = zscore(d, keys, "driver_lagged", "driver_lagged_z", zero_when_constant=True)
    ws = whole_series(keys)
    sd = F.stddev_pop("target").over(ws) * F.stddev_pop("driver_lagged").over(ws)
    return d.withColumn("correlation", F.try_divide(F.covar_pop("target", "driver_lagged").over(ws), sd))


def top_moves(df: DataFrame, keys: Sequence[str], period: str, value: str, k: int = 3) -> DataFrame:
    """The k largest |value| per series; ties -> earliest period.
    ``row_number() <= k`` is planned as a partial+final WindowGroupLimit."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), F.col(period).asc())
    return (df.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def local_tail(df: DataFrame, keys: Sequence[str], period: str, value: str, cutoff,
               n: int = 10) -> DataFrame:
    """The last <= n non-NULL points at or before ``cutoff``."""
    w = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    d = df.where(F.col(value).isNotNull() & (F.col(period) <= F.lit(cutoff)))
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def support_guard(df: DataFrame, keys: Sequence[str], value: str, min_n: int,
                  reason: str = "insufficient_points") -> tuple[DataFrame, DataFrame]:
    """Keep series with at least ``min_n`` non-NULL values; the rest are
    reported as (keys, reason, n) instead of silently vanishing."""
    n = F.count(value).over(whole_series(keys))
    d = df.withColumn("_support", n)
    kept = d.where(F.col("_support") >= min_n).drop("_support")
    rejected = (d.where(F.col("_support") < min_n).groupBy(*keys)
                .agg(F.max("_support").cast("bigint").alias("n"))
                .withColumn("reason", F.lit(reason)).select(*keys, "reason", "n"))
    return kept, rejected


# Warning texts reported by ``transform_warnings``.
WARN_FEW = "fewer than 2 points"
WARN_NO_BASE = "no non-zero base value"
WARN_ZERO_STD = "zero standard deviation"
WARN_NONPOS = "non-positive values omitted"


def transform_warnings(df: DataFrame, keys: Sequence[str], kinds: Sequence[str],
                       value: str = "value", min_points: int = 2) -> DataFrame:
    """Why a series is omitted from (or thinned in) a transform, as rows
    (keys, kind, warning, n) from one grouped aggregate: too few points, no
    non-zero base (base-100 family), zero std (z-score), and the number of
    non-positive values dropped by log10."""
    v = F.col(value)
    g = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(v != 0).alias("_nz"),
        F.count_if(v <= 0).alias("_np"), F.stddev_pop(v).alias("_sd"))
    def row(kind, warning, n):
        return F.struct(F.lit(kind).alias("kind"), F.lit(warning).alias("warning"),
                        n.cast("bigint").alias("n"))

    rows = []
    for kind in kinds:
        few = F.col("_n") < min_points
        rows.append(row(kind, WARN_FEW, F.when(few, F.col("_n"))))
        if kind in ("base100", "log10_base100", "cum_change"):
            rows.append(row(kind, WARN_NO_BASE, F.when(~few & (F.col("_nz") == 0), F.col("_n"))))
        if kind == "zscore":
            rows.append(row(kind, WARN_ZERO_STD, F.when(~few & (F.col("_sd") == 0), F.col("_n"))))
        if kind == "log10":
            rows.append(row(kind, WARN_NONPOS, F.when(~few & (F.col("_np") > 0), F.col("_np"))))
    out = g.select(*keys, F.inline(F.array(*rows)))
    return out.where(F.col("n").isNotNull())
