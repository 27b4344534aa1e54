"""Registered series-transform queries (W1-W16, O4) over the test panels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cadence.operators import transforms as T
from cadence.plans import sql as S
from cadence.plans.panels import build_pa, build_pb
from cadence.plans.registry import register, rnd

PA_KEYS = ["o_orderpriority", "metric"]
PB_KEYS = ["c_nationkey", "metric"]
BASE = dt.date(1996, 1, 1)
BASE_SQL = "DATE '1996-01-01'"
CUTOFF = dt.date(2000, 12, 1)
CUTOFF_SQL = "DATE '2000-12-01'"


def pa_long(spark, sf):
    return build_pa(spark, sf).long()


def pb_long(spark, sf):
    return build_pb(spark, sf).long()


# ---------------------------------------------------------------- W4/W5 (flagship)
def _transform_sql(src_ctes: str, src: str, keys: list[str], expr: str, label: str,
                   needs_base: bool, extra_where: str = "", base_sql: str = BASE_SQL) -> str:
    k = ", ".join(keys)
    base = (f", arg_min({{'v': original, 'p': period}}, CASE WHEN original <> 0 THEN "
            f"{{'a': CAST(period < {base_sql} AS INTEGER), 'p': period}} END) "
            f"OVER (PARTITION BY {k}) AS bs") if needs_base else ", NULL AS bs"
    bp = "struct_extract(bs, 'p')" if needs_base else "CAST(NULL AS DATE)"
    return S.with_(src_ctes, f"""
d AS (SELECT {k}, period, value AS original, COUNT(*) OVER (PARTITION BY {k}) AS n
      FROM {src} WHERE value IS NOT NULL AND period IS NOT NULL),
b AS (SELECT * {base} FROM d WHERE n >= 2),
t AS (SELECT {k}, period, original, {expr} AS transformed, '{label}' AS axis_label,
             {bp} AS base_period FROM b)""") + f"""
SELECT * FROM t WHERE transformed IS NOT NULL AND isfinite(transformed) {extra_where}"""


BV = "struct_extract(bs, 'v')"


@register("w05_base100", _transform_sql(S.PA_LONG, "pa_long", PA_KEYS,
                                        f"original / {BV} * 100", "Index base 100", True))
def w05_base100(spark, sf):
    """Flagship: PA monthly panel -> base value (W4) -> base-100 index."""
    return T.transform_series(pa_long(spark, sf), PA_KEYS, kind="base100", base_period=BASE)


@register("w04_base_value", S.with_(S.PA_LONG, f"""
b AS (SELECT o_orderpriority, metric,
             arg_min({{'v': value, 'p': period}}, CASE WHEN value <> 0 THEN
               {{'a': CAST(period < DATE '1999-06-01' AS INTEGER), 'p': period}} END) AS bs
      FROM pa_long WHERE value IS NOT NULL GROUP BY 1, 2)""") + """
SELECT o_orderpriority, metric, struct_extract(bs, 'v') AS base_value,
       struct_extract(bs, 'p') AS base_period FROM b""")
def w04_base_value(spark, sf):
    """Per-series base value and the period it came from (requested
    1999-06; later non-zero, else earliest non-zero)."""
    return T.base_values(pa_long(spark, sf), PA_KEYS, "period", "value", dt.date(1999, 6, 1))


@register("w06_log10", _transform_sql(S.PA_LONG, "pa_long", PA_KEYS,
                                      "round(CASE WHEN original > 0 THEN log10(original) END, 6) + 0.0",
                                      "Log10(value)", False))
def w06_log10(spark, sf):
    """log10 of positive values; non-positive points omitted."""
    return rnd(T.transform_series(pa_long(spark, sf), PA_KEYS, kind="log10"), ["transformed"])


@register("w07_log10_base100", _transform_sql(
    S.PA_LONG, "pa_long", PA_KEYS,
    f"round(CASE WHEN original / {BV} * 100 > 0 THEN log10(original / {BV} * 100) END, 6) + 0.0",
    "Log10(index base 100)", True))
def w07_log10_base100(spark, sf):
    """log10 of the base-100 index."""
    return rnd(T.transform_series(pa_long(spark, sf), PA_KEYS, kind="log10_base100",
                                  base_period=BASE), ["transformed"])


@register("w08_cum_change", _transform_sql(S.PA_LONG, "pa_long", PA_KEYS,
                                           f"(original / {BV} - 1) * 100",
                                           "Cumulative change (%)", True))
def w08_cum_change(spark, sf):
    """Cumulative % change against the base value."""
    return T.transform_series(pa_long(spark, sf), PA_KEYS, kind="cum_change", base_period=BASE)


@register("w09_zscore", _transform_sql(
    S.PA_LONG, "pa_long", PA_KEYS,
    "CASE WHEN stddev_pop(original) OVER w > 0 THEN round((original - avg(original) OVER w) / "
    "stddev_pop(original) OVER w, 6) + 0.0 END", "Z-score", False).replace(
    "FROM b)", "FROM b WINDOW w AS (PARTITION BY o_orderpriority, metric))"))
def w09_zscore(spark, sf):
    """Z-score with population std; constant series omitted."""
    return rnd(T.transform_series(pa_long(spark, sf), PA_KEYS, kind="zscore"), ["transformed"])


@register("w02a_pct_change_skip", _transform_sql(
    S.PB_LONG, "pb_long", PB_KEYS,
    "(original / NULLIF(lag(original) OVER (PARTITION BY c_nationkey, metric ORDER BY period), 0)"
    " - 1) * 100", "Period change (%)", False))
def w02a_pct_change_skip(spark, sf):
    """Period % change against the previous *available* value (gaps in
    the densified PB panel are skipped)."""
    return T.transform_series(pb_long(spark, sf), PB_KEYS, kind="pct_change")


@register("w02b_pct_change_keep", S.with_(S.PB_LONG) + """
SELECT c_nationkey, metric, period, value,
       (value / NULLIF(lag(value) OVER (PARTITION BY c_nationkey, metric ORDER BY period), 0) - 1)
         * 100 AS pct_change
FROM pb_long""")
def w02b_pct_change_keep(spark, sf):
    """Gap-preserving % change: a NULL neighbour gives NULL."""
    return T.pct_change(pb_long(spark, sf), PB_KEYS, "period", "value", "pct_change")


@register("w01_shift", S.with_(S.PB_LONG) + """
SELECT c_nationkey, metric, period, value,
       lag(value, 2) OVER w AS value_lag2, lead(value, 1) OVER w AS value_lead1
FROM pb_long WINDOW w AS (PARTITION BY c_nationkey, metric ORDER BY period)""")
def w01_shift(spark, sf):
    """Positional shifts by +2 and -1 rows."""
    d = T.shift(pb_long(spark, sf), PB_KEYS, "period", "value", 2, "value_lag2")
    return T.shift(d, PB_KEYS, "period", "value", -1, "value_lead1")


@register("w03_diff", S.with_(S.PB_LONG) + """
SELECT c_nationkey, metric, period, value,
       value - lag(value) OVER (PARTITION BY c_nationkey, metric ORDER BY period) AS diff
FROM pb_long""")
def w03_diff(spark, sf):
    """Absolute difference to the previous row."""
    return T.diff(pb_long(spark, sf), PB_KEYS, "period", "value")


# Units of the PA metrics (metric catalog).
PA_UNITS = {"order_value": "USD", "order_count": "orders", "line_revenue": "USD",
            "line_qty": "units", "avg_discount": "rate %"}


def _unit_case(col: str = "metric") -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{m}' THEN '{u}'" for m, u in PA_UNITS.items()) + " END"


def with_units(df):
    m = F.create_map(*[x for kv in PA_UNITS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn("unit", m[F.col("metric")])


_W10_SQL = S.with_(S.PA_LONG, f"""
u AS (SELECT *, {_unit_case()} AS unit FROM pa_long WHERE value IS NOT NULL AND period IS NOT NULL),
d AS (SELECT *, COUNT(*) OVER w AS n, max(abs(value)) OVER w AS mx FROM u
      WINDOW w AS (PARTITION BY o_orderpriority, metric)),
s AS (SELECT *, CASE WHEN mx IS NULL OR unit LIKE '%\\%%' ESCAPE '\\' OR unit LIKE '%MXN/USD%'
                       OR lower(unit) LIKE '%index%' THEN 1.0
                     WHEN lower(unit) = 'persons' THEN 1e6
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e12 THEN 1e12
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e9 THEN 1e9
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e6 THEN 1e6
                     ELSE 1.0 END AS f,
                CASE WHEN mx IS NULL OR unit LIKE '%\\%%' ESCAPE '\\' OR unit LIKE '%MXN/USD%'
                       OR lower(unit) LIKE '%index%' THEN unit
                     WHEN lower(unit) = 'persons' THEN 'millions of persons'
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e12 THEN 'trillions ' || unit
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e9 THEN 'billions ' || unit
                     WHEN (unit LIKE '%USD%' OR unit LIKE '%MXN%') AND mx >= 1e6 THEN 'millions ' || unit
                     ELSE unit END AS lbl
      FROM d WHERE n >= 2)""") + """
SELECT o_orderpriority, metric, period, value AS original, value / f AS transformed,
       lbl AS axis_label, CAST(NULL AS DATE) AS base_period FROM s"""


@register("w10_original_scaled", _W10_SQL)
def w10_original_scaled(spark, sf):
    """Original values with per-series magnitude scaling by unit."""
    return T.transform_series(with_units(pa_long(spark, sf)), PA_KEYS, kind="original",
                              unit="unit")


@register("w10_real_terms", S.with_(S.PA_LONG, """
r AS (SELECT o_orderpriority, period, value, metric = 'line_revenue' AS used_real,
             CASE WHEN metric = 'line_revenue' THEN 'order_value' ELSE metric END AS metric FROM pa_long),
h AS (SELECT *, bool_or(used_real) OVER (PARTITION BY o_orderpriority, metric) AS there FROM r)""") + """
SELECT o_orderpriority, metric, period, value, used_real,
       CASE WHEN NOT used_real THEN metric || ': no real version, original kept' END AS warning
FROM h WHERE used_real = there""")
def w10_real_terms(spark, sf):
    """Metrics in real terms; line revenue is the real version of order
    value, the other metrics have none and carry the warning."""
    d = T.real_terms(pa_long(spark, sf), ["o_orderpriority"], "metric", {"order_value": "line_revenue"})
    return d.select("o_orderpriority", "metric", "period", "value", "used_real", "warning")


# (unit, multiplier of the order value): every branch of the scaling rule
P11_CASES = (("USD", 1e7), ("USD", 1e4), ("USD", 1.0), ("USD", 1e-7), ("MXN", 1e7), ("MXN", 1e4), ("persons", 1.0),
             ("MXN/USD", 1e7), ("USD/person", 1e4), ("rate %", 1e7), ("Index", 1e7), ("orders", 1e7))


@register("p11_display_scale", S.with_(S.PB_LONG, """
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{u}', CAST({m!r} AS DOUBLE))" for u, m in P11_CASES) + """) AS c(unit, mult)),
v AS (SELECT c_nationkey, unit, mult, period, value * mult AS x FROM pb_long, c WHERE metric = 'order_value'),
m AS (SELECT *, MAX(abs(x)) OVER (PARTITION BY c_nationkey, unit, mult) AS mx FROM v),
f AS (SELECT *, CASE WHEN mx IS NULL OR unit IN ('MXN/USD', 'rate %', 'Index') THEN 1.0 WHEN unit = 'persons' THEN 1e6
                     WHEN unit NOT LIKE '%USD%' AND unit NOT LIKE '%MXN%' THEN 1.0
                     WHEN mx >= 1e12 THEN 1e12 WHEN mx >= 1e9 THEN 1e9 WHEN mx >= 1e6 THEN 1e6 ELSE 1.0 END AS factor FROM m)""") + """
SELECT c_nationkey, unit, mult, period, x / factor AS scaled, CAST(factor AS DOUBLE) AS factor,
       CASE WHEN factor = 1 THEN unit WHEN unit = 'persons' THEN 'millions of persons'
            WHEN factor = 1e12 THEN 'trillions ' || unit WHEN factor = 1e9 THEN 'billions ' || unit
            ELSE 'millions ' || unit END AS label FROM f""")
def p11_display_scale(spark, sf):
    """Display scaling with its factor, the order values of every nation
    under units and magnitudes that reach each branch of the rule."""
    cases = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(m).alias("mult")) for u, m in P11_CASES])
    d = build_pb(spark, sf).long().where(F.col("metric") == "order_value").withColumn("_c", F.explode(cases))
    d = d.select("c_nationkey", "_c.unit", "_c.mult", "period", (F.col("value") * F.col("_c.mult")).alias("x"))
    scaled, label, factor = T.display_scale(F.col("x"), F.col("unit"), ["c_nationkey", "unit", "mult"])
    return d.select("c_nationkey", "unit", "mult", "period", scaled.alias("scaled"), factor.alias("factor"), label.alias("label"))


@register("w11_shares", S.with_("""
sh AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
              CAST(SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS total,
              CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100.0 AS part_f,
              CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100.0 AS part_o
       FROM orders GROUP BY 1, 2),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY o_orderpriority) AS n FROM sh
      WHERE total IS NOT NULL AND part_f IS NOT NULL AND part_o IS NOT NULL)""") + """
SELECT o_orderpriority, period, part_f / NULLIF(total, 0) * 100 AS part_f_share,
       part_o / NULLIF(total, 0) * 100 AS part_o_share FROM c WHERE n >= 2""")
def w11_shares(spark, sf):
    """Composition shares of order value by order status, per priority."""
    from cadence.plans.panels import dollars, money, read
    from cadence.panel import month_start
    o = read(spark, sf, "orders")
    p = money("o_totalprice")
    wide = o.groupBy("o_orderpriority", month_start("o_orderdate").alias("period")).agg(
        dollars(F.sum(p)).alias("total"),
        dollars(F.sum(F.when(F.col("o_orderstatus") == "F", p).otherwise(F.lit(0)))).alias("part_f"),
        dollars(F.sum(F.when(F.col("o_orderstatus") == "O", p).otherwise(F.lit(0)))).alias("part_o"))
    return T.shares(wide, ["o_orderpriority"], "period", "total", ["part_f", "part_o"])


@register("w12_elasticity", S.with_(S.PA_WIDE, """
c AS (SELECT o_orderpriority, period, line_revenue, order_value FROM pa
      WHERE line_revenue IS NOT NULL AND order_value IS NOT NULL),
p AS (SELECT *, (line_revenue / NULLIF(lag(line_revenue) OVER w, 0) - 1) * 100 AS target_pct,
             (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS driver_pct
      FROM c WINDOW w AS (PARTITION BY o_orderpriority ORDER BY period))""") + """
SELECT * FROM (SELECT *, target_pct / NULLIF(CASE WHEN abs(driver_pct) >= 0.1 THEN driver_pct END, 0)
                 AS elasticity FROM p) WHERE elasticity IS NOT NULL AND isfinite(elasticity)""")
def w12_elasticity(spark, sf):
    """Elasticity of line revenue with respect to order value."""
    wide = build_pa(spark, sf).df
    return T.elasticity(wide, ["o_orderpriority"], "period", "line_revenue", "order_value")


@register("w13_lag_pair", S.with_(S.PB_WIDE, """
ch AS (SELECT c_nationkey, period,
              (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS target,
              (order_count / NULLIF(lag(order_count) OVER w, 0) - 1) * 100 AS driver
       FROM pb WINDOW w AS (PARTITION BY c_nationkey ORDER BY period)),
lg AS (SELECT c_nationkey, period, target,
              lag(driver, 2) OVER (PARTITION BY c_nationkey ORDER BY period) AS driver_lagged FROM ch),
c AS (SELECT * FROM lg WHERE target IS NOT NULL AND driver_lagged IS NOT NULL)""") + """
SELECT c_nationkey, period, target, driver_lagged,
  round(COALESCE(CASE WHEN stddev_pop(target) OVER w > 0 THEN (target - avg(target) OVER w) / stddev_pop(target) OVER w END, 0.0), 6) + 0.0 AS target_z,
  round(COALESCE(CASE WHEN stddev_pop(driver_lagged) OVER w > 0 THEN (driver_lagged - avg(driver_lagged) OVER w) / stddev_pop(driver_lagged) OVER w END, 0.0), 6) + 0.0 AS driver_lagged_z,
  round(covar_pop(target, driver_lagged) OVER w / NULLIF(stddev_pop(target) OVER w * stddev_pop(driver_lagged) OVER w, 0), 6) + 0.0 AS correlation
FROM c WINDOW w AS (PARTITION BY c_nationkey)""")
def w13_lag_pair(spark, sf):
    """Order-value change vs order-count change lagged 2 periods,
    standardised, per nation (densified PB panel)."""
    wide = build_pb(spark, sf).df
    d = T.lag_pair(wide, ["c_nationkey"], "period", "order_value", "order_count", 2, True)
    return rnd(d, ["target_z", "driver_lagged_z", "correlation"])


@register("w14_top_moves", _transform_sql(
    S.PB_LONG, "pb_long", PB_KEYS,
    "(original / NULLIF(lag(original) OVER (PARTITION BY c_nationkey, metric ORDER BY period), 0)"
    " - 1) * 100", "Period change (%)", False).replace(
    "SELECT * FROM t WHERE transformed IS NOT NULL AND isfinite(transformed)",
    """SELECT c_nationkey, metric, period, transformed, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, metric ORDER BY abs(transformed) DESC, period)
    AS rank FROM t WHERE transformed IS NOT NULL AND isfinite(transformed)) WHERE rank <= 3"""))
def w14_top_moves(spark, sf):
    """The three largest absolute period changes per series."""
    t = T.transform_series(pb_long(spark, sf), PB_KEYS, kind="pct_change")
    return T.top_moves(t, PB_KEYS, "period", "transformed", 3).select(
        *PB_KEYS, "period", "transformed", F.col("rank").cast("int").alias("rank"))


@register("w15_local_tail", S.with_(S.PB_LONG) + f"""
SELECT c_nationkey, metric, period, value FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, metric ORDER BY period DESC) AS rn
  FROM pb_long WHERE value IS NOT NULL AND period <= {CUTOFF_SQL}) WHERE rn <= 10""")
def w15_local_tail(spark, sf):
    """The last <= 10 observed points at or before the cut-off."""
    return T.local_tail(pb_long(spark, sf), PB_KEYS, "period", "value", CUTOFF, 10)


@register("w16_support_guard", S.with_(S.PB_LONG, """
n AS (SELECT c_nationkey, metric, COUNT(value) AS n FROM pb_long GROUP BY 1, 2)""") + """
SELECT c_nationkey, metric, 'insufficient_points' AS reason, n FROM n WHERE n < 80""")
def w16_support_guard(spark, sf):
    """Series with fewer than 80 monthly observations are rejected with
    their count (the kept series continue downstream)."""
    _, rejected = T.support_guard(pb_long(spark, sf), PB_KEYS, "value", 80)
    return rejected


@register("w06_transform_warnings", S.with_(S.PB_LONG, """
ch AS (SELECT c_nationkey, metric, period,
              (value / NULLIF(lag(value) OVER (PARTITION BY c_nationkey, metric ORDER BY period), 0) - 1) * 100 AS value
       FROM pb_long),
g AS (SELECT c_nationkey, metric, COUNT(*) AS n, COUNT(*) FILTER (WHERE value <> 0) AS nz,
             COUNT(*) FILTER (WHERE value <= 0) AS np, STDDEV_POP(value) AS sd
      FROM ch WHERE value IS NOT NULL GROUP BY 1, 2)""") + """
SELECT * FROM (
  SELECT c_nationkey, metric, k.kind, 'fewer than 2 points' AS warning, CASE WHEN n < 2 THEN n END AS n
  FROM g, (VALUES ('base100'), ('log10'), ('zscore')) AS k(kind)
  UNION ALL SELECT c_nationkey, metric, 'base100', 'no non-zero base value', CASE WHEN n >= 2 AND nz = 0 THEN n END FROM g
  UNION ALL SELECT c_nationkey, metric, 'log10', 'non-positive values omitted', CASE WHEN n >= 2 AND np > 0 THEN np END FROM g
  UNION ALL SELECT c_nationkey, metric, 'zscore', 'zero standard deviation', CASE WHEN n >= 2 AND sd = 0 THEN n END FROM g
) WHERE n IS NOT NULL""")
def w06_transform_warnings(spark, sf):
    """W6/W9 warnings: per series of PB period changes, the points log10
    omits and the series that base-100 or z-score cannot use."""
    ch = T.pct_change(pb_long(spark, sf), PB_KEYS, "period", "value", "change")
    ch = ch.select(*PB_KEYS, "period", F.col("change").alias("value"))
    return T.transform_warnings(ch, PB_KEYS, ["base100", "log10", "zscore"])
