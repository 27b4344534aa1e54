"""Registered aggregation queries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from cadence.operators import project as P
from cadence.operators import quality as Q
from cadence.operators import relate as R
from cadence.operators import scoring as SC
from cadence.operators import summary as A
from cadence.operators import transforms as T
from cadence.panel import to_long
from cadence.plans import sql as S
from cadence.plans.panels import PA_METRICS, build_pa, build_pb, build_sc, build_tx, read
from cadence.plans.q_joins import TX_JOIN, tx_joined
from cadence.plans.q_series import BASE, PA_KEYS, PA_UNITS, _unit_case, _transform_sql, with_units
from cadence.plans.registry import register, rnd

PB_KEYS = ["c_nationkey", "metric"]


@register("a01_first_last", S.with_(S.PB_LONG) + """
SELECT c_nationkey, metric,
       MIN(period) FILTER (WHERE value IS NOT NULL) AS first_period,
       arg_min(value, period) FILTER (WHERE value IS NOT NULL) AS first_value,
       MAX(period) FILTER (WHERE value IS NOT NULL) AS last_period,
       arg_max(value, period) FILTER (WHERE value IS NOT NULL) AS last_value
FROM pb_long GROUP BY 1, 2""")
def a01_first_last(spark, sf):
    """A1: first/last non-NULL observation per series of the densified PB panel."""
    return A.first_last(build_pb(spark, sf).long(), PB_KEYS)


@register("a02_stats", S.with_(S.PA_LONG) + f"""
SELECT o_orderpriority, metric, COUNT(value) AS n, MIN(value) AS min_value, MAX(value) AS max_value,
       {S.r6('AVG(value)')} AS mean_value, {S.r6('MEDIAN(value)')} AS median_value,
       {S.r6('STDDEV_POP(value)')} AS std_value
FROM pa_long GROUP BY 1, 2""")
def a02_stats(spark, sf):
    """A2: count, min, max, mean, median, population std per series."""
    return rnd(A.stats(build_pa(spark, sf).long(), PA_KEYS),
               ["mean_value", "median_value", "std_value"])


TREND_SQL = S.with_(S.PA_LONG, f"""
g AS (SELECT o_orderpriority, metric, {_unit_case()} AS unit, COUNT(*) AS n,
             MIN(period) AS first_period, arg_min(value, period) AS first_value,
             MAX(period) AS last_period, arg_max(value, period) AS last_value,
             MIN(value) AS min_value, MAX(value) AS max_value
      FROM pa_long WHERE value IS NOT NULL GROUP BY 1, 2, 3)""") + """
SELECT *, CASE WHEN first_value <> 0 THEN (last_value / first_value - 1) * 100 END AS total_change_pct,
       CASE WHEN date_diff('month', first_period, last_period) > 0 AND first_value > 0 AND last_value > 0
            THEN round((pow(last_value / first_value, 1.0 / date_diff('month', first_period, last_period)) - 1) * 100, 6) + 0.0
       END AS cagr_pct
FROM g WHERE n >= 2"""


@register("a03_trend_summary", TREND_SQL)
def a03_trend_summary(spark, sf):
    """A3: trend summary per series: first/last, total change, compound
    growth per month, min, max."""
    long = with_units(build_pa(spark, sf).long())   # unit depends on the metric only
    return rnd(A.trend_summary(long, [*PA_KEYS, "unit"], "period", "value", "month"),
               ["cagr_pct"])


@register("a04_kpi", S.with_(S.PA_LONG) + """
SELECT o_orderpriority, metric, MAX(period) AS last_period, arg_max(value, period) AS last_value,
       COUNT(*) AS n_periods,
       CASE WHEN arg_min(value, period) <> 0 THEN (arg_max(value, period) / arg_min(value, period) - 1) * 100 END AS change_pct
FROM pa_long WHERE value IS NOT NULL GROUP BY 1, 2""")
def a04_kpi(spark, sf):
    """A4: KPI per series: last value, change vs first, periods with data."""
    return A.kpi(build_pa(spark, sf).long(), PA_KEYS)


@register("a05_coverage", S.with_(S.PB_WIDE, """
pbx AS (SELECT *, CAST(NULL AS DOUBLE) AS extra_index FROM pb)""",
                                  S.long_cte("cov", "pbx", ["c_nationkey"],
                                             ["order_value", "order_count", "extra_index"])) + """
SELECT c_nationkey, metric, COUNT(value) AS n_periods,
       MIN(period) FILTER (WHERE value IS NOT NULL) AS first_period,
       MAX(period) FILTER (WHERE value IS NOT NULL) AS last_period
FROM cov GROUP BY 1, 2""")
def a05_coverage(spark, sf):
    """A5: coverage per series from the unfiltered panel, including a
    reserved metric without any data (0 / NULL)."""
    pb = Q.add_missing(build_pb(spark, sf).df, ["extra_index"])
    long = to_long(pb, ["c_nationkey"], "period", ["order_value", "order_count", "extra_index"])
    return A.coverage(long, PB_KEYS)


@register("a06_lineage", S.with_(TX_JOIN) + """
SELECT DISTINCT field, value FROM (
  SELECT 'src_document' AS field, NULLIF(trim(src_document), '') AS value FROM tx
  UNION ALL SELECT 'src_label', NULLIF(trim(src_label), '') FROM tx) WHERE value IS NOT NULL""")
def a06_lineage(spark, sf):
    """Lineage roll-up of every 'src_' column: distinct non-blank values."""
    return A.lineage(tx_joined(spark, sf), "src_")


@register("a07_distinct_values", """
SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'""")
def a07_distinct_values(spark, sf):
    """Sorted distinct entities except the focus entity."""
    return A.distinct_values(read(spark, sf, "orders"), "o_orderpriority", ["3-MEDIUM"])


def _corr_sql(x: str, y: str, min_n: int = 2) -> tuple[str, str]:
    n = f"COUNT(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    sx = f"STDDEV_POP(CASE WHEN {y} IS NOT NULL THEN {x} END)"
    sy = f"STDDEV_POP(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    r = (f"CASE WHEN {n} >= {min_n} AND {sx} > 0 AND {sy} > 0 "
         f"THEN round(COVAR_POP({x}, {y}) / ({sx} * {sy}), 6) + 0.0 END")
    return r, n


def _pearson_sql(src_ctes: str, src: str, keys: list[str], metrics: list[str]) -> str:
    k = ", ".join(keys)
    aggs, rows = [], []
    for a, b in combinations_with_replacement(range(len(metrics)), 2):
        r, n = _corr_sql(metrics[a], metrics[b])
        aggs += [f"{r} AS r_{a}_{b}", f"{n} AS n_{a}_{b}"]
        rows.append(f"SELECT {k}, '{metrics[a]}' AS metric_x, '{metrics[b]}' AS metric_y, r_{a}_{b} AS r, n_{a}_{b} AS n FROM g")
        if a != b:
            rows.append(f"SELECT {k}, '{metrics[b]}', '{metrics[a]}', r_{a}_{b}, n_{a}_{b} FROM g")
    return S.with_(src_ctes, f"g AS (SELECT {k}, {', '.join(aggs)} FROM {src} GROUP BY {k})") + \
        "\nUNION ALL ".join(rows)


PA_M = list(PA_METRICS)


@register("a08_pearson_levels", _pearson_sql(S.PA_WIDE, "pa", ["o_orderpriority"], PA_M))
def a08_pearson_levels(spark, sf):
    """Pearson matrix of the five PA metrics per priority, on levels."""
    d = R.correlation_matrix(build_pa(spark, sf).df, ["o_orderpriority"], "period", PA_M)
    return rnd(d, ["r"])


@register("a08_pearson_changes", _pearson_sql(S.PB_WIDE + """,
pbc AS (SELECT c_nationkey, period,
               (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS order_value,
               (order_count / NULLIF(lag(order_count) OVER w, 0) - 1) * 100 AS order_count
        FROM pb WINDOW w AS (PARTITION BY c_nationkey ORDER BY period))""", "pbc",
                                              ["c_nationkey"], ["order_value", "order_count"]))
def a08_pearson_changes(spark, sf):
    """Pearson matrix on gap-preserving % changes per nation (PB)."""
    d = R.correlation_matrix(build_pb(spark, sf).df, ["c_nationkey"], "period",
                             ["order_value", "order_count"], use_changes=True)
    return rnd(d, ["r"])


def _spearman_sql() -> str:
    pairs = []
    for a, b in combinations_with_replacement(range(len(PA_M)), 2):
        pairs.append(f"SELECT o_orderpriority, '{PA_M[a]}' AS metric_x, '{PA_M[b]}' AS metric_y, "
                     f"{PA_M[a]} AS x, {PA_M[b]} AS y FROM pa")
    body = "\n UNION ALL ".join(pairs)
    r, n = _corr_sql("rx", "ry")
    return S.with_(S.PA_WIDE, f"""
pl AS ({body}),
c AS (SELECT * FROM pl WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT o_orderpriority, metric_x, metric_y,
              rank() OVER (PARTITION BY o_orderpriority, metric_x, metric_y ORDER BY x)
                + (COUNT(*) OVER (PARTITION BY o_orderpriority, metric_x, metric_y, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY o_orderpriority, metric_x, metric_y ORDER BY y)
                + (COUNT(*) OVER (PARTITION BY o_orderpriority, metric_x, metric_y, y) - 1) / 2.0 AS ry
       FROM c),
g AS (SELECT o_orderpriority, metric_x, metric_y, COUNT(*) AS n, {r} AS r FROM rk GROUP BY 1, 2, 3)""") + """
SELECT o_orderpriority, metric_x, metric_y, r, n FROM g
UNION ALL SELECT o_orderpriority, metric_y, metric_x, r, n FROM g WHERE metric_x <> metric_y"""


@register("a09_spearman", _spearman_sql())
def a09_spearman(spark, sf):
    """Spearman matrix (average ranks on pairwise-complete rows) per priority."""
    d = R.spearman_matrix(build_pa(spark, sf).df, ["o_orderpriority"], "period", PA_M)
    return rnd(d, ["r"])


def _xcorr_sql() -> str:
    cols, aggs, rows = [], [], []
    for i, k in enumerate(range(-5, 6)):
        sh = f"lag(d, {k}) OVER w" if k >= 0 else f"lead(d, {-k}) OVER w"
        cols.append(f"{sh} AS d{i}")
        r, n = _corr_sql("t", f"d{i}", 4)
        aggs += [f"{r} AS r{i}", f"{n} AS n{i}"]
        rows.append(f"SELECT c_nationkey, {k} AS lag, r{i} AS r, n{i} AS n FROM g")
    return S.with_(S.PB_WIDE, f"""
ch AS (SELECT c_nationkey, period,
              (order_value / NULLIF(lag(order_value) OVER w, 0) - 1) * 100 AS t,
              (order_count / NULLIF(lag(order_count) OVER w, 0) - 1) * 100 AS d
       FROM pb WINDOW w AS (PARTITION BY c_nationkey ORDER BY period)),
sh AS (SELECT c_nationkey, t, {', '.join(cols)} FROM ch
       WINDOW w AS (PARTITION BY c_nationkey ORDER BY period)),
g AS (SELECT c_nationkey, {', '.join(aggs)} FROM sh GROUP BY 1)""") + "\nUNION ALL ".join(rows)


@register("a10_cross_correlation", _xcorr_sql())
def a10_cross_correlation(spark, sf):
    """A10: cross-correlation of order-value vs order-count changes for lags
    -5..5 per nation, r NULL when n < 4."""
    d = R.cross_correlation(build_pb(spark, sf).df, ["c_nationkey"], "period", "order_value",
                            "order_count", use_changes=True)
    return rnd(d.withColumn("lag", F.col("lag").cast("int")), ["r"])


MATCH_SQL = S.SC + """,
mf AS (
  SELECT *, CASE WHEN goals_for > goals_against
                   OR (goals_for = goals_against AND shootout_win = 1 AND phase <> 'group') THEN 'W'
                 WHEN goals_for < goals_against THEN 'L' ELSE 'D' END AS result,
         CAST(phase <> 'group' AS INTEGER) AS is_knockout,
         CAST(rival_titles >= 1 OR rival_top4 >= 2 AS INTEGER) AS strong_rival,
         CAST(rival_appearances < 2 AND rival_ko_wins = 0 AS INTEGER) AS weak_rival
  FROM sc),
mp AS (
  SELECT *, CAST(10 * (goals_for - goals_against) + 20 * CAST(result = 'W' AS INTEGER)
            + 40 * CAST(result = 'W' AS INTEGER) * is_knockout
            + 3 * CAST(result = 'W' AS INTEGER) * strong_rival
            - 2 * CAST(result = 'L' AS INTEGER) * weak_rival AS DOUBLE) / 10.0 AS match_points
  FROM mf)"""

SCORE_SQL = MATCH_SQL + """,
ps AS (
  SELECT parent_id, COUNT(*) AS matches, CAST(SUM(CAST(result = 'W' AS INTEGER)) AS BIGINT) AS wins,
         CAST(SUM(goals_for - goals_against) AS BIGINT) AS goal_diff,
         CAST(SUM(CAST(result = 'W' AS INTEGER) * is_knockout) AS BIGINT) AS ko_wins,
         CAST(SUM(CAST(result = 'W' AS INTEGER) * strong_rival) AS BIGINT) AS wins_vs_strong,
         CAST(SUM(CAST(result = 'L' AS INTEGER) * weak_rival) AS BIGINT) AS losses_vs_weak,
         COUNT(DISTINCT phase) AS phases, MAX(is_knockout) AS reached_knockout,
         CAST(COUNT(DISTINCT phase) - 1 + arg_max(is_knockout * CAST(result = 'W' AS INTEGER), {'m': match_no, 'k': is_knockout * CAST(result = 'W' AS INTEGER)}) AS INTEGER) AS phases_passed
  FROM mp GROUP BY 1),
pss AS (
  SELECT *, CAST(10 * goal_diff + 20 * wins + 30 * phases_passed + 40 * ko_wins + 3 * wins_vs_strong
                 - 2 * losses_vs_weak AS DOUBLE) / 10.0 AS score_total FROM ps)"""


@register("a11_weighted_score", S.with_(SCORE_SQL) + """
SELECT parent_id, matches, wins, goal_diff, ko_wins, wins_vs_strong, losses_vs_weak, phases,
       reached_knockout, phases_passed, score_total, score_total / matches AS score_per_match FROM pss""")
def a11_weighted_score(spark, sf):
    """Weighted child-to-parent score (matches -> tournament) per order."""
    return SC.parent_scores(build_sc(spark, sf))


@register("a11_match_points", S.with_(MATCH_SQL) + """
SELECT parent_id, match_no, result, is_knockout, strong_rival, weak_rival, match_points FROM mp""")
def a11_match_points(spark, sf):
    """A11 (per match): result, knockout/strength flags and match points."""
    return SC.match_flags(build_sc(spark, sf)).select(
        "parent_id", "match_no", "result", "is_knockout", "strong_rival", "weak_rival",
        "match_points")


@register("p09_flag_conjunction", S.with_(SCORE_SQL) + """
SELECT parent_id, matches, wins, score_total FROM pss
WHERE reached_knockout = 1 AND wins >= 1 AND matches >= 4""")
def p09_flag_conjunction(spark, sf):
    """Parents that reached a knockout AND won a match AND played >= 4."""
    s = SC.parent_scores(build_sc(spark, sf))
    return P.all_of(s, F.col("reached_knockout") == 1, F.col("wins") >= 1,
                    F.col("matches") >= 4).select("parent_id", "matches", "wins", "score_total")


@register("a12_mixed_units", S.with_(S.PA_LONG) + f"""
SELECT o_orderpriority, COUNT(DISTINCT unit) AS n_units,
       array_to_string(list_sort(list_distinct(list(unit))), ', ') AS units,
       'series have different units; compare indexed or standardised values' AS warning
FROM (SELECT *, {_unit_case()} AS unit FROM pa_long) GROUP BY 1 HAVING COUNT(DISTINCT unit) > 1""")
def a12_mixed_units(spark, sf):
    """Warning rows where the selected series mix units."""
    d = A.mixed_units(with_units(build_pa(spark, sf).long()), "unit", ["o_orderpriority"])
    return d.withColumn("units", F.array_join("units", ", "))


@register("a13_bounds", _transform_sql(S.PA_LONG, "pa_long", PA_KEYS,
                                       "original / struct_extract(bs, 'v') * 100",
                                       "Index base 100", True).replace(
    "SELECT * FROM t WHERE transformed IS NOT NULL AND isfinite(transformed)",
    """SELECT metric, MIN(transformed) AS min_value, MAX(transformed) AS max_value,
       MAX(transformed) - MIN(transformed) AS span
FROM t WHERE transformed IS NOT NULL AND isfinite(transformed) GROUP BY metric"""))
def a13_bounds(spark, sf):
    """Min, max and span of all base-100 values per metric."""
    t = T.transform_series(build_pa(spark, sf).long(), PA_KEYS, kind="base100", base_period=BASE)
    return A.bounds(t, "transformed", ["metric"])


@register("u02_distinct", "SELECT DISTINCT lang, source FROM documents")
def u02_distinct(spark, sf):
    """Duplicate elimination of (language, source) labels."""
    return read(spark, sf, "documents").select("lang", "source").distinct()


# ------------------------------------------------------------------ O1-O3: sorts
@register("o01_sort_period", S.with_(S.PB_WIDE) + """
SELECT * FROM pb ORDER BY period ASC NULLS LAST, c_nationkey""")
def o01_sort_period(spark, sf):
    """O1: ascending period sort, NULLs last (total order: range-partitioned
    sort, no single-task collect)."""
    return build_pb(spark, sf).df.orderBy(F.col("period").asc_nulls_last(), "c_nationkey")


@register("o02_sort_mixed", S.with_(S.EV) + """
SELECT * FROM ev ORDER BY start ASC NULLS LAST, severity DESC NULLS LAST, event_id""")
def o02_sort_mixed(spark, sf):
    """O2: mixed-direction multi-key sort (start asc, severity desc)."""
    from cadence.plans.panels import build_ev
    return build_ev(spark, sf).orderBy(F.col("start").asc_nulls_last(),
                                       F.col("severity").desc_nulls_last(), "event_id")


@register("o03_sort_abs", _transform_sql(
    S.PB_LONG, "pb_long", PB_KEYS,
    "(original / NULLIF(lag(original) OVER (PARTITION BY c_nationkey, metric ORDER BY period), 0)"
    " - 1) * 100", "Period change (%)", False).replace(
    "SELECT * FROM t WHERE transformed IS NOT NULL AND isfinite(transformed)",
    """SELECT c_nationkey, metric, period, transformed FROM t
WHERE transformed IS NOT NULL AND isfinite(transformed)
ORDER BY abs(transformed) DESC, c_nationkey, metric, period"""))
def o03_sort_abs(spark, sf):
    """O3: period changes sorted by absolute value, descending."""
    t = T.transform_series(build_pb(spark, sf).long(), PB_KEYS, kind="pct_change")
    return t.select(*PB_KEYS, "period", "transformed").orderBy(
        F.abs("transformed").desc(), *PB_KEYS, "period")
