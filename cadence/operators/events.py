"""Interval events over panels.

Intervals are attached to periods with ``explode(sequence(start, end))``
followed by an *equi*-join on the period, never a theta join: the join is a
plain hash/sort-merge join whose cost grows with the covered periods.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.exprs import safe_div
from cadence.panel import add_periods, period_index, period_step


def overlapping(events: DataFrame, lo, hi, categories: Sequence[str] | None = None,
                severity: tuple[int, int] | None = None, start: str = "start", end: str = "end",
                category: str = "category", sev: str = "severity") -> DataFrame:
    """Events overlapping [lo, hi] (end >= lo and start <= hi) with a
    category selection and a severity range.  A NULL end never overlaps;
    ``categories=None`` means no category filter, an empty list selects none."""
    cond = (F.col(end) >= F.lit(lo)) & (F.col(start) <= F.lit(hi))
    if categories is not None:
        cond = cond & F.col(category).isin(list(categories)) if categories else F.lit(False)
    if severity is not None:
        cond = cond & F.col(sev).between(severity[0], severity[1])
    return events.where(F.coalesce(cond, F.lit(False)))


def explode_intervals(events: DataFrame, freq: str, start: str = "start", end: str = "end",
                      period: str = "period", bounds=None) -> DataFrame:
    """One row per (event, covered period); ``band_mid`` is the interval
    midpoint in period-index units (the centre of a shaded band).  ``bounds``
    (first, last period of interest) clips the interval before it is exploded,
    so an open-ended one costs no more than the panel is long."""
    mid = (period_index(start, freq) + period_index(end, freq)) / 2.0
    lo, hi = F.col(start), F.col(end)
    if bounds is not None:
        lo, hi = F.greatest(lo, bounds[0]), F.least(hi, bounds[1])
    d = events.withColumns({"_lo": lo, "_hi": hi, "band_mid": mid}).where("_lo <= _hi")
    return d.withColumn(period, F.explode(F.sequence("_lo", "_hi", period_step(freq)))).drop("_lo", "_hi")


def selected(panel: DataFrame, keys: Sequence[str], series: Sequence[Sequence]) -> DataFrame:
    """The rows of the ``series`` selected by their key values."""
    if not series:
        return panel.limit(0)
    one = [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, s, strict=True)]) for s in series]
    return panel.where(reduce(lambda a, b: a | b, one))


def overlay(events: DataFrame, panel: DataFrame, freq: str, period: str = "period",
            start: str = "start", end: str = "end", keys: Sequence[str] = (), series: Sequence[Sequence] | None = None) -> DataFrame:
    """Attach every event to each period of a series that it covers.

    ``keys`` tell the panel's series apart: all of them are drawn over, or those
    whose key values ``series`` selects.  Without keys the panel must hold one
    series, and a second row for a covered period fails the query.  The panel is
    looked up once per distinct interval, clipped to the panel's own periods, and
    the events are joined back to their interval; a hot day is left to AQE's skew
    join.  The output has a row per event, covered period and series."""
    if series is not None:
        panel = selected(panel, keys, series)
    elif not keys:
        k = F.row_number().over(Window.partitionBy(period).orderBy(period))
        twice = F.raise_error(F.concat(F.lit("select the series to overlay: several rows for period "), F.col(period).cast("string")))
        panel = panel.withColumn("_k", k).where(F.when(F.col("_k") > 1, twice.cast("boolean")).otherwise(True)).drop("_k")
    ends = panel.select(F.struct(F.min(period).alias("lo"), F.max(period).alias("hi"))).scalar()
    spans = events.where(F.col(end) >= F.col(start)).select(start, end).distinct()
    covered = explode_intervals(spans, freq, start, end, period, (ends.getField("lo"), ends.getField("hi")))
    return events.join(covered.join(panel, period, "inner"), [start, end], "inner")


def event_study(events: DataFrame, panel: DataFrame, keys: Sequence[str], freq: str, series: Sequence[Sequence],
                period: str = "period", value: str = "value", event_cols: Sequence[str] = ("event_id",),
                start: str = "start", end: str = "end") -> DataFrame:
    """Value one period before the start, at the end and one period after
    the end of each event, for each of the selected ``series`` (their key values),
    with the % change before->during and during->after (NULL when the base is NULL
    or 0).

    There is a row for every (event, selected series), with NULL values where the
    series has none.  The (phase, period) lookups and their pivot are done once per
    distinct interval and series, and the events are joined to the result."""
    kinds = [panel.schema[k].dataType for k in keys]
    chosen = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, t, v in zip(keys, kinds, s, strict=True)]) for s in series])
    spans = events.select(F.col(start).alias("_s"), F.col(end).alias("_e")).distinct()
    ph = spans.select("_s", "_e", F.explode(F.array(
        F.struct(F.lit("before").alias("phase"), add_periods("_s", -1, freq).alias(period)),
        F.struct(F.lit("during").alias("phase"), F.col("_e").alias(period)),
        F.struct(F.lit("after").alias("phase"), add_periods("_e", 1, freq).alias(period)),
    )).alias("_p")).select("_s", "_e", "_p.phase", f"_p.{period}")
    j = ph.join(selected(panel, keys, series).select(*keys, period, value), period, "inner")
    g = j.groupBy("_s", "_e", *keys).agg(
        *[F.max(F.when(F.col("phase") == p, F.col(value))).alias(p)
          for p in ("before", "during", "after")])
    g = g.withColumns({
        "change_before_during_pct": (safe_div(F.col("during"), F.col("before")) - 1) * 100,
        "change_during_after_pct": (safe_div(F.col("after"), F.col("during")) - 1) * 100})
    g = g.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    pairs = events.select(*event_cols, start, end, F.explode(chosen).alias("_series")).select(*event_cols, start, end, "_series.*")
    same = [F.col(start).eqNullSafe(F.col("_s")), F.col(end).eqNullSafe(F.col("_e")), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return pairs.join(g, same, "left").drop("_s", "_e", start, end, *[f"_k_{k}" for k in keys])
