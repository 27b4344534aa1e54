"""Registered join queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadence.functions.exprs import combine_text
from cadence.operators import compare as C
from cadence.operators import enrich as E
from cadence.operators import events as EV
from cadence.plans import sql as S
from cadence.plans.panels import build_ev, build_pb, build_pc, build_tx
from cadence.plans.q_quality import IND_SQL, SERIES_CODES, wide_indicators
from cadence.plans.registry import register
from cadence.sources import indicators as IND

TX_JOIN = S.TX + """,
tx AS (SELECT d.*, l.label_quality, l.toxic, l.label_note, l.src_label
       FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id)"""


def tx_joined(spark, sf):
    docs, labels = build_tx(spark, sf)
    return E.validated_left_join(docs, labels, ["doc_id"])


@register("j01_validated_left_join", S.with_(TX_JOIN) + "SELECT * FROM tx")
def j01_validated_left_join(spark, sf):
    """Documents left-joined to labels, one-to-one validated on both sides."""
    return tx_joined(spark, sf)


@register("j02_precedence", S.with_(TX_JOIN) + """
SELECT doc_id, COALESCE(label_quality, quality) AS quality, quality AS quality_original FROM tx""")
def j02_precedence(spark, sf):
    """Enriched label quality takes precedence over the derived base value;
    the base value is kept as quality_original."""
    d = E.precedence(tx_joined(spark, sf), {"quality": "label_quality"})
    return d.select("doc_id", "quality", "quality_original")


def _combine_sql(exprs: list[str]) -> str:
    arr = "[" + ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs) + "]"
    t = (f"list_filter(list_transform({arr}, lambda x: trim(x)), "
         f"lambda x: x IS NOT NULL AND x <> '' AND lower(x) <> 'nan')")
    return t


@register("j03_text_merge", S.with_(TX_JOIN, f"""
m AS (SELECT doc_id, source AS source_original,
             {_combine_sql(['source', 'label_note'])} AS t1,
             {_combine_sql(['lang', 'label_note', 'lang', "'NaN'"])} AS t2 FROM tx)""") + """
SELECT doc_id, source_original,
       array_to_string(list_filter(t1, lambda x, i: list_position(t1, x) = i), ' | ') AS source,
       array_to_string(list_filter(t2, lambda x, i: list_position(t2, x) = i), ' | ') AS tags
FROM m""")
def j03_text_merge(spark, sf):
    """Text merge without blanks, 'nan' or duplicates, joined by ' | '."""
    d = E.merge_text(tx_joined(spark, sf), "source", "label_note")
    d = d.withColumn("tags", combine_text("lang", "label_note", "lang", F.lit("NaN")))
    return d.select("doc_id", "source", "source_original", "tags")


@register("j04_interval_overlap", S.with_(S.EV) + """
SELECT * FROM ev WHERE category IN ('app', 'network') AND severity BETWEEN 2 AND 4
  AND "end" >= DATE '2024-01-10' AND start <= DATE '2024-01-20'""")
def j04_interval_overlap(spark, sf):
    """Events overlapping a period range, by category and severity."""
    return EV.overlapping(build_ev(spark, sf), dt.date(2024, 1, 10), dt.date(2024, 1, 20),
                          ["app", "network"], (2, 4))


@register("j05_interval_overlay", S.with_(S.EV, S.PC_LONG, """
ex AS (SELECT event_id, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS period,
              (date_diff('day', DATE '1970-01-01', start) + date_diff('day', DATE '1970-01-01', "end")) / 2.0 AS band_mid
       FROM ev WHERE "end" >= start)""") + """
SELECT ex.event_id, ex.period, ex.band_mid, p.event_type, p.metric, p.value
FROM ex JOIN pc_long p ON ex.period = p.period""")
def j05_interval_overlay(spark, sf):
    """Every error interval attached to each daily panel row it covers
    (explode + equi-join, no theta join)."""
    pc = build_pc(spark, sf).long()
    ev = build_ev(spark, sf).select("event_id", "start", "end")
    return EV.overlay(ev, pc, "day", keys=["event_type", "metric"]).select("event_id", "period", "band_mid", "event_type",
                                                                           "metric", "value")


@register("j06_event_study", S.with_(S.EV, S.PC_LONG, """
ph AS (SELECT event_id, 'before' AS phase, CAST(start - INTERVAL 1 DAY AS DATE) AS period FROM ev
       UNION ALL SELECT event_id, 'during', "end" FROM ev
       UNION ALL SELECT event_id, 'after', CAST("end" + INTERVAL 1 DAY AS DATE) FROM ev),
f AS (SELECT ph.event_id, p.event_type,
             MAX(CASE WHEN phase = 'before' THEN value END) AS before,
             MAX(CASE WHEN phase = 'during' THEN value END) AS during,
             MAX(CASE WHEN phase = 'after' THEN value END) AS after
      FROM ph JOIN pc_long p ON ph.period = p.period AND p.metric = 'value_sum'
      GROUP BY 1, 2),
ty AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS event_type),
g AS (SELECT ev.event_id, ty.event_type, f.before, f.during, f.after
      FROM ev CROSS JOIN ty LEFT JOIN f ON ev.event_id = f.event_id AND ty.event_type = f.event_type)""") + """
SELECT *, (during / NULLIF(before, 0) - 1) * 100 AS change_before_during_pct,
          (after / NULLIF(during, 0) - 1) * 100 AS change_during_after_pct FROM g""")
def j06_event_study(spark, sf):
    """Before / during / after values of daily value sums around every
    error interval, for each event type, with % changes."""
    pc = build_pc(spark, sf).long().where(F.col("metric") == "value_sum")
    types = [("click",), ("error",), ("purchase",), ("signup",), ("view",)]
    return EV.event_study(build_ev(spark, sf), pc, ["event_type"], "day", types)


def code_map(spark):
    return spark.createDataFrame(list(SERIES_CODES.items()), "metric string, code string")


@register("j08_entity_comparison", S.with_(IND_SQL, """
sel AS (SELECT * FROM ind WHERE value IS NOT NULL AND series_code = 'OV.TOT'
          AND country_name IN ('NATION_0', 'NATION_3', 'NATION_7') AND year BETWEEN 1995 AND 2001)""") + """
SELECT * FROM sel WHERE COUNT(*) OVER (PARTITION BY series_code, country_name) >= 2""".replace(
    "SELECT * FROM sel WHERE COUNT(*) OVER (PARTITION BY series_code, country_name) >= 2",
    "SELECT * EXCLUDE (cnt) FROM (SELECT *, COUNT(*) OVER (PARTITION BY series_code, country_name) AS cnt FROM sel) WHERE cnt >= 2"))
def j08_entity_comparison(spark, sf):
    """Metric -> external code lookup, then the focus nation and two
    others compared over the indicator table (entities with < 2 points dropped)."""
    ind = IND.melt_indicators(wide_indicators(spark, sf))
    return C.entity_comparison(ind, code_map(spark), "order_value", "NATION_0",
                               ["NATION_3", "NATION_7"], 1995, 2001)


@register("j09_observed_bridge", S.with_(S.PB_LONG, """
o AS (SELECT c_nationkey, period, value,
             CASE WHEN period <= DATE '2000-12-01' THEN 'train' ELSE 'after' END AS segment
      FROM pb_long WHERE metric = 'order_value' AND value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, segment ORDER BY period DESC) AS rn,
             MAX(CAST(segment = 'after' AS INTEGER)) OVER (PARTITION BY c_nationkey) AS has_after FROM o)""") + """
SELECT c_nationkey, period, value, segment FROM r
UNION ALL
SELECT c_nationkey, period, value, 'after' FROM r WHERE segment = 'train' AND rn = 1 AND has_after = 1""")
def j09_observed_bridge(spark, sf):
    """Observed order value split at the 2000-12 cut-off plus the bridge row."""
    pb = build_pb(spark, sf).long().where(F.col("metric") == "order_value")
    return C.observed_bridge(pb, ["c_nationkey"], "period", "value", dt.date(2000, 12, 1))
