"""Panel data model: wide <-> long conversion, series windows, period spine.

Wide:  keys..., period, metric_1 ... metric_p   (unique on keys + period)
Long:  keys..., metric, period, value           (unique on keys + metric + period)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

METRIC = "metric"
VALUE = "value"


def series_window(keys: Sequence[str], period: str = "period") -> WindowSpec:
    """``Window.partitionBy(keys).orderBy(period)``.  Keys are mandatory: an
    un-partitioned window would move every row into one task."""
    if not keys:
        raise ValueError("series windows need at least one key column")
    return Window.partitionBy(*keys).orderBy(F.col(period).asc_nulls_last())


def whole_series(keys: Sequence[str]) -> WindowSpec:
    if not keys:
        raise ValueError("series windows need at least one key column")
    return Window.partitionBy(*keys)


def to_long(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str],
            metric_col: str = METRIC, value_col: str = VALUE) -> DataFrame:
    """Unpivot metric columns; NULL values are kept (coverage relies on it)."""
    cast = df.select(*keys, period, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot([*keys, period], list(metrics), metric_col, value_col)


def to_wide(long: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str],
            metric_col: str = METRIC, value_col: str = VALUE) -> DataFrame:
    """Pivot long back to wide; the metric list is explicit so Spark plans a
    single aggregation without a distinct-values job."""
    return long.groupBy(*keys, period).pivot(metric_col, list(metrics)).agg(F.first(value_col))


def month_start(c: Column | str) -> Column:
    """First day of the month of a timestamp/date column, as DATE."""
    return F.trunc(F.col(c).cast("date") if isinstance(c, str) else c.cast("date"), "MM")


def period_index(c: Column | str, freq: str) -> Column:
    """Numeric position of a period: year number, months or days since epoch."""
    col = F.col(c) if isinstance(c, str) else c
    if freq == "year":
        return col.cast("bigint")
    if freq == "month":
        return (F.year(col) * 12 + F.month(col) - 1).cast("bigint")
    if freq == "day":
        return F.datediff(col, F.lit("1970-01-01").cast("date")).cast("bigint")
    raise ValueError(f"unknown frequency {freq!r}")


def add_periods(c: Column | str, n: Column | int, freq: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    n = F.lit(n) if isinstance(n, int) else n
    if freq == "year":
        return col + n
    if freq == "month":
        return F.add_months(col, n)
    if freq == "day":
        return F.date_add(col, n)
    raise ValueError(f"unknown frequency {freq!r}")


def period_step(freq: str) -> Column:
    if freq == "year":
        return F.lit(1)
    if freq == "month":
        return F.expr("INTERVAL 1 MONTH")
    if freq == "day":
        return F.expr("INTERVAL 1 DAY")
    raise ValueError(f"unknown frequency {freq!r}")


def spine(entities: DataFrame, keys: Sequence[str], start: Column, end: Column,
          freq: str, period: str = "period") -> DataFrame:
    """Dense (entity x period) grid: one ``explode(sequence(start, end))`` per
    distinct entity row.  ``start``/``end`` may be literals or scalar
    subqueries; no cross join is planned."""
    return (entities.select(*keys).distinct()
            .select(*keys, F.explode(F.sequence(start, end, period_step(freq))).alias(period)))


def densify(panel: DataFrame, entities: DataFrame, keys: Sequence[str], period: str,
            start: Column, end: Column, freq: str) -> DataFrame:
    """Left-join a panel onto its spine so missing periods become NULL rows."""
    grid = spine(entities, keys, start, end, freq, period)
    return grid.join(panel, [*keys, period], "left")


@dataclass(frozen=True)
class Panel:
    """A wide panel plus its layout; a thin, immutable description."""

    df: DataFrame
    keys: tuple[str, ...]
    period: str = "period"
    metrics: tuple[str, ...] = field(default_factory=tuple)
    freq: str = "month"

    def long(self) -> DataFrame:
        return to_long(self.df, self.keys, self.period, self.metrics)

    @property
    def series_keys(self) -> list[str]:
        return [*self.keys, METRIC]

    def with_df(self, df: DataFrame) -> "Panel":
        return Panel(df, self.keys, self.period, self.metrics, self.freq)


# ---------------------------------------------------------------- convenience
def _long_keys(p: Panel) -> list[str]:
    return [*p.keys, METRIC]


def transform(panel: Panel, kind: str, base_period=None, unit: str | None = None) -> DataFrame:
    """Every series of the panel through one transform."""
    from cadence.operators.transforms import transform_series
    return transform_series(panel.long(), _long_keys(panel), panel.period, VALUE, kind,
                            base_period, unit)


def trend(panel: Panel) -> DataFrame:
    """Trend summary of every series (A3)."""
    from cadence.operators.summary import trend_summary
    return trend_summary(panel.long(), _long_keys(panel), panel.period, VALUE, panel.freq)


def coverage_of(panel: Panel) -> DataFrame:
    """Coverage of every series (A5)."""
    from cadence.operators.summary import coverage
    return coverage(panel.long(), _long_keys(panel), panel.period, VALUE)


def correlations(panel: Panel, use_changes: bool = False, method: str = "pearson") -> DataFrame:
    """Correlation matrix of the panel's metrics per entity."""
    from cadence.operators import relate
    fn = relate.correlation_matrix if method == "pearson" else relate.spearman_matrix
    return fn(panel.df, list(panel.keys), panel.period, list(panel.metrics), use_changes)


def forecast(panel: Panel, target: str, predictors, **kw) -> dict:
    """Per-entity model fit and projection (M1-M16); see ``fit_predict``."""
    from cadence.operators.forecast import fit_predict
    return fit_predict(panel.df, list(panel.keys), panel.period, target, list(predictors),
                       freq=panel.freq, **kw)


Panel.transform = transform
Panel.trend = trend
Panel.coverage = coverage_of
Panel.correlations = correlations
Panel.forecast = forecast
