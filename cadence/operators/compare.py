"""Cross-entity comparison and model-chart joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.panel import whole_series


def entity_comparison(indicators: DataFrame, code_map: DataFrame, metric: str, focus: str,
                      others: Sequence[str], lo: int, hi: int, entity: str = "country_name",
                      code: str = "series_code", period: str = "year") -> DataFrame:
    """Look the metric up in the code map, keep the
    focus entity plus the chosen others inside the period range, and drop
    any entity with fewer than two points."""
    codes = code_map.where(F.col("metric") == metric).select(F.col("code").alias("_code"))
    chosen = list(dict.fromkeys([focus, *others]))
    d = (indicators.join(codes, indicators[code] == F.col("_code"), "left_semi")
         .where(F.col(entity).isin(chosen) & F.col(period).between(lo, hi)))
    return (d.withColumn("_n", F.count(F.lit(1)).over(whole_series([code, entity])))
            .where(F.col("_n") >= 2).drop("_n"))


def observed_bridge(df: DataFrame, keys: Sequence[str], period: str, value: str, cutoff) -> DataFrame:
    """Observed points split at the training cut-off, plus one bridge row
    (the last training point repeated in the 'after' segment) for series that
    have observations after the cut-off."""
    d = df.where(F.col(value).isNotNull()).select(*keys, period, value)
    is_train = F.col(period) <= F.lit(cutoff)
    d = d.withColumn("segment", F.when(is_train, F.lit("train")).otherwise(F.lit("after")))
    has_after = F.max((~is_train).cast("int")).over(whole_series(keys))
    last_train = F.row_number().over(
        Window.partitionBy(*keys, "segment").orderBy(F.col(period).desc()))
    d = d.withColumns({"_after": has_after, "_rn": last_train})
    bridge = (d.where((F.col("segment") == "train") & (F.col("_rn") == 1) & (F.col("_after") == 1))
              .withColumn("segment", F.lit("after")))
    return d.unionByName(bridge).drop("_after", "_rn")
