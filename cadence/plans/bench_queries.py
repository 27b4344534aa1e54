
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadence.operators import relate as R
from cadence.operators import transforms as T
from cadence.operators.forecast import pipeline as PL
from cadence.plans.panels import build_pb
from cadence.plans.q_forecast import CUT, customer_panel
from cadence.plans.registry import load_all


def pb_transform_sweep(spark, sf):
    """PB panel build + every series transform, from one window stage."""
    kinds = ("base100", "log10", "log10_base100", "pct_change", "cum_change", "zscore")
    return T.transform_kinds(build_pb(spark, sf).long(), ["c_nationkey", "metric"], kinds, base_period=dt.date(1996, 1, 1))


def corr_and_lags(spark, sf):
    """Pearson matrix on changes + cross-correlation lags -5..5, 25 nations."""
    pb = build_pb(spark, sf).df
    m = R.correlation_matrix(pb, ["c_nationkey"], "period", ["order_value", "order_count"], True)
    x = R.cross_correlation(pb, ["c_nationkey"], "period", "order_value", "order_count",
                            use_changes=True)
    return m.select("c_nationkey", F.col("metric_x").alias("a"), F.col("metric_y").alias("b"),
                    "r", "n").unionByName(
        x.select("c_nationkey", F.col("lag").cast("string").alias("a"), F.lit("lag").alias("b"),
                 "r", "n"))


def customer_ols_projection(spark, sf):
    """Lag-feature OLS + recursive projection with entity = customer."""
    out = PL.fit_predict(customer_panel(spark, sf), ["o_custkey"], "period", "order_value",
                         ["order_count"], model="ols", lag=1, horizon=6, mode="growth",
                         cutoff=CUT, freq="month")
    return out["predictions"].unionByName(
        out["rejections"].select("o_custkey", F.lit(None).cast("date").alias("period"),
                                 F.lit(None).cast("double").alias("actual"),
                                 F.lit(None).cast("double").alias("predicted"),
                                 F.lit(None).cast("double").alias("predicted_model"),
                                 F.col("reason").alias("kind")))


def headline():
    q = load_all()
    return {
        "pa_base100": q["w05_base100"].build,
        "pb_transforms": pb_transform_sweep,
        "corr_lags": corr_and_lags,
        "customer_ols_projection": customer_ols_projection,
        "nation_elastic_net": q["m07_elastic_net"].build,
        "event_study": q["j06_event_study"].build,
    }
