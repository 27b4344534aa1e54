"""Projection, filters and derived columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.exprs import nonblank
from cadence.panel import period_index, whole_series


def select_existing(df: DataFrame, wanted: Sequence[str],
                    rename: Mapping[str, str] | None = None) -> DataFrame:
    """Explicit column list intersected with the columns present."""
    present = [c for c in wanted if c in df.columns]
    out = df.select(*present)
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    return out


def with_literals(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """P5: version / lineage literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def resolve_metrics(long: DataFrame, catalog: DataFrame, available: Iterable[str],
                    use_real: bool, metric: str = "metric") -> DataFrame:
    """Map each catalog label to its physical series — the real-terms
    column when asked for and present, else the original — and attach unit
    and a used-real flag."""
    avail = list(available)
    real_ok = (F.lit(use_real) & F.coalesce(F.col("real_column").isin(avail), F.lit(False))
               if avail else F.lit(False))
    cat = catalog.select(
        "label",
        F.when(real_ok, F.col("real_column")).otherwise(F.col("column")).alias("_col"),
        F.when(real_ok, F.coalesce("real_unit", "unit")).otherwise(F.col("unit")).alias("unit"),
        real_ok.alias("used_real"))
    j = long.join(cat, long[metric] == cat["_col"], "inner")
    return j.withColumnRenamed("_col", "column").drop(metric)


def period_range(df: DataFrame, period: str, lo, hi) -> DataFrame:
    """Inclusive period range (pushed to the Parquet scan when ``period``
    is a source column)."""
    return df.where(F.col(period).between(F.lit(lo), F.lit(hi)))


def membership(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Multi-select membership.  An empty selection means no filter; NULL
    never matches.  A list becomes ``isin``, a DataFrame of values a left-semi
    join."""
    if isinstance(values, DataFrame):
        vals = values.select(F.col(values.columns[0]).alias("_v")).distinct()
        return df.join(vals, df[column] == vals["_v"], "left_semi")
    values = list(values)
    if not values:
        return df
    return df.where(F.col(column).isin(values))


def all_of(df: DataFrame, *conditions: Column) -> DataFrame:
    """Conjunction of flag conditions (NULL counts as false)."""
    cond = F.lit(True)
    for c in conditions:
        cond = cond & F.coalesce(c, F.lit(False))
    return df.where(cond)


def nonblank_rows(df: DataFrame, column: str) -> DataFrame:
    """P10: keep rows whose text is not blank."""
    return df.where(nonblank(column).isNotNull())


def trend_offset(df: DataFrame, keys: Sequence[str], period: str, freq: str,
                 out: str = "trend") -> DataFrame:
    """Period offset from the series' first period, in period steps."""
    idx = period_index(period, freq)
    return df.withColumn(out, idx - F.min(idx).over(whole_series(keys)))
