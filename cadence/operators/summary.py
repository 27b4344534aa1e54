"""Aggregations and summaries (A1-A7, A12, A13).  Every summary is one
``groupBy(keys)`` with partial aggregation, so skewed keys are combined
map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.exprs import finite, nonblank, safe_div
from cadence.panel import period_index


def _first_last(period: str, value: str):
    v, p = F.col(value), F.col(period)
    keep = F.when(v.isNotNull(), p)
    return [F.min(keep).alias("first_period"), F.min_by(v, keep).alias("first_value"),
            F.max(keep).alias("last_period"), F.max_by(v, keep).alias("last_value")]


def first_last(long: DataFrame, keys: Sequence[str], period: str = "period",
               value: str = "value") -> DataFrame:
    """A1: first and last non-NULL observation and their periods."""
    return long.groupBy(*keys).agg(*_first_last(period, value))


def stats(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """A2: count, min, max, mean, median, population std."""
    v = F.col(value)
    return long.groupBy(*keys).agg(
        F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.avg(v).alias("mean_value"), F.median(v).alias("median_value"),
        F.stddev_pop(v).alias("std_value"))


def trend_summary(long: DataFrame, keys: Sequence[str], period: str, value: str, freq: str,
                  min_points: int = 2) -> DataFrame:
    """A3: first/last, total change %, compound growth per period (only when
    the span is positive and both ends are > 0), min and max; series with
    fewer than ``min_points`` points are omitted."""
    d = long.where(F.col(value).isNotNull())
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_first_last(period, value),
                             F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    span = period_index("last_period", freq) - period_index("first_period", freq)
    fv, lv = F.col("first_value"), F.col("last_value")
    cagr = F.when((span > 0) & (fv > 0) & (lv > 0),
                  (F.pow(lv / fv, F.lit(1.0) / span) - 1) * 100)
    total = F.when(fv != 0, (lv / fv - 1) * 100)
    return (g.where(F.col("n") >= min_points)
            .withColumns({"total_change_pct": total, "cagr_pct": cagr}))


def kpi(long: DataFrame, keys: Sequence[str], period: str = "period", value: str = "value") -> DataFrame:
    """A4: last value, % change against the first value, number of periods
    with data (series with at least one point)."""
    d = long.where(F.col(value).isNotNull())
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_periods"), *_first_last(period, value))
    return g.select(*keys, "last_period", "last_value", "n_periods",
                    F.when(F.col("first_value") != 0,
                           (F.col("last_value") / F.col("first_value") - 1) * 100).alias("change_pct"))


def coverage(long: DataFrame, keys: Sequence[str], period: str = "period",
             value: str = "value") -> DataFrame:
    """A5: non-NULL count and first/last period with data per series, from
    the unfiltered long panel; a series without data is listed with 0/NULL."""
    keep = F.when(F.col(value).isNotNull(), F.col(period))
    return long.groupBy(*keys).agg(F.count(value).alias("n_periods"),
                                   F.min(keep).alias("first_period"),
                                   F.max(keep).alias("last_period"))


def lineage(df: DataFrame, prefix: str) -> DataFrame:
    """Distinct non-blank trimmed values of every column whose name starts
    with ``prefix``, as (field, value)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    if not cols:
        return df.sparkSession.createDataFrame([], "field string, value string")
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "field", "raw")
    return (long.select("field", nonblank("raw").alias("value")).where(F.col("value").isNotNull())
            .distinct())


def distinct_values(df: DataFrame, column: str, exclude: Sequence | None = None) -> DataFrame:
    """Sorted distinct values of a dimension (optionally excluding some)."""
    d = df.select(column).where(F.col(column).isNotNull())
    if exclude:
        d = d.where(~F.col(column).isin(list(exclude)))
    return d.distinct().orderBy(column)


def mixed_units(df: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """One warning row per group whose selected series carry more than
    one distinct unit."""
    g = df.groupBy(*keys).agg(F.countDistinct(unit).alias("n_units"),
                              F.array_sort(F.collect_set(unit)).alias("units"))
    return g.where(F.col("n_units") > 1).withColumn(
        "warning", F.lit("series have different units; compare indexed or standardised values"))


def bounds(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Min, max and span of the finite values."""
    v = finite(value)
    return df.groupBy(*keys).agg(F.min(v).alias("min_value"), F.max(v).alias("max_value")) \
        .withColumn("span", F.col("max_value") - F.col("min_value"))


def change_vs_first(first: str, last: str):
    return (safe_div(F.col(last), F.col(first)) - 1) * 100
