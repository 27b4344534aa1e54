"""DuckDB SQL fragments (CTEs) that rebuild the test panels independently of
Spark; the driver runs ``oracle_sql()`` against the same parquet tables."""

from __future__ import annotations

PA_WIDE = """
pa_li AS (
  SELECT l_orderkey,
         SUM(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * (100 - CAST(floor(l_discount * 100 + 0.5) AS BIGINT))) AS rev,
         SUM(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT)) AS qty,
         SUM(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS disc,
         COUNT(*) AS nl
  FROM lineitem GROUP BY l_orderkey),
pa AS (
  SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS order_value,
         CAST(COUNT(*) AS DOUBLE) AS order_count,
         CAST(SUM(rev) AS DOUBLE) / 10000.0 AS line_revenue,
         CAST(SUM(qty) AS DOUBLE) / 100.0 AS line_qty,
         (CAST(SUM(disc) AS DOUBLE) / 100.0) / NULLIF(CAST(SUM(nl) AS DOUBLE), 0) AS avg_discount
  FROM orders LEFT JOIN pa_li ON o_orderkey = l_orderkey
  GROUP BY 1, 2)"""

PA_METRICS = ("order_value", "order_count", "line_revenue", "line_qty", "avg_discount")
PB_METRICS = ("order_value", "order_count")
PC_METRICS = ("n", "value_sum", "users")


def long_cte(name: str, src: str, keys: list[str], metrics, period: str = "period") -> str:
    k = ", ".join(keys)
    parts = [f"SELECT {k}, '{m}' AS metric, {period}, CAST({m} AS DOUBLE) AS value FROM {src}"
             for m in metrics]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


PA_LONG = PA_WIDE + ",\n" + long_cte("pa_long", "pa", ["o_orderpriority"], PA_METRICS)

PB_WIDE = """
pb_cust AS (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS value, COUNT(*) AS cnt
  FROM orders GROUP BY 1, 2),
pb_agg AS (
  SELECT c_nationkey, period, CAST(SUM(value) AS DOUBLE) / 100.0 AS order_value,
         CAST(SUM(cnt) AS DOUBLE) AS order_count
  FROM pb_cust JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
pb_spine AS (
  SELECT n_nationkey AS c_nationkey, CAST(unnest(generate_series(
           (SELECT MIN(CAST(date_trunc('month', o_orderdate) AS DATE)) FROM orders),
           (SELECT MAX(CAST(date_trunc('month', o_orderdate) AS DATE)) FROM orders),
           INTERVAL 1 MONTH)) AS DATE) AS period
  FROM nation),
pb AS (
  SELECT s.c_nationkey, s.period, a.order_value, a.order_count
  FROM pb_spine s LEFT JOIN pb_agg a ON s.c_nationkey = a.c_nationkey AND s.period = a.period)"""

PB_LONG = PB_WIDE + ",\n" + long_cte("pb_long", "pb", ["c_nationkey"], PB_METRICS)

PC_WIDE = """
pc AS (
  SELECT event_type, CAST(ts AS DATE) AS period,
         CAST(COUNT(*) AS DOUBLE) AS n,
         CAST(SUM(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS value_sum,
         CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS users
  FROM events GROUP BY 1, 2)"""

PC_LONG = PC_WIDE + ",\n" + long_cte("pc_long", "pc", ["event_type"], PC_METRICS)

EV = """
ev AS (
  SELECT event_id, CAST(ts AS DATE) AS start,
         CAST(CAST(ts AS DATE) + CAST(event_id % 3 AS INTEGER) AS DATE) AS "end",
         ['app', 'network', 'storage'][CAST(user_id % 3 + 1 AS INTEGER)] AS category,
         CAST(event_id % 5 + 1 AS INTEGER) AS severity,
         'error #' || CAST(event_id AS VARCHAR) AS title,
         props AS description, 'events' AS source
  FROM events WHERE event_type = 'error')"""

SC = """
sc AS (
  SELECT l_orderkey AS parent_id, CAST(l_linenumber AS INTEGER) AS match_no,
         ['group', 'group', 'group', 'round_of_16', 'quarter_final', 'semi_final', 'final'][
            CAST(LEAST(l_linenumber, 7) AS INTEGER)] AS phase,
         CAST(l_quantity AS INTEGER) % 5 AS goals_for,
         CAST(round(l_tax * 100) AS INTEGER) % 4 AS goals_against,
         CASE WHEN l_returnflag = 'R' THEN CAST(CAST(l_quantity AS INTEGER) % 5 = CAST(round(l_tax * 100) AS INTEGER) % 4 AS INTEGER) ELSE 0 END AS shootout_win,
         CAST(l_partkey % 7 = 0 AS INTEGER) AS rival_titles,
         CAST(l_suppkey % 4 AS INTEGER) AS rival_top4,
         CAST(l_suppkey % 6 AS INTEGER) AS rival_appearances,
         CAST(l_partkey % 3 AS INTEGER) AS rival_ko_wins
  FROM lineitem)"""

TX = """
docs AS (
  SELECT doc_id, lang, source, n_chars, CAST(n_chars >= 1000 AS INTEGER) AS quality,
         source AS src_document FROM documents),
labs AS (
  SELECT doc_id, quality AS label_quality, toxic,
         CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS label_note,
         'labels' AS src_label FROM labels)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def r6(expr: str, digits: int = 6) -> str:
    """Round a floating result (adding 0.0 turns -0.0 into 0.0)."""
    return f"(round({expr}, {digits}) + 0.0)"


def sig(expr: str, digits: int = 7) -> str:
    """Round to significant digits (mirror of ``registry.sig``)."""
    e = f"floor(log10(abs({expr})))"
    p = f"pow(10.0, abs({e}))"
    scaled = f"(CASE WHEN {e} >= 0 THEN ({expr}) / {p} ELSE ({expr}) * {p} END)"
    r = f"round({scaled}, {digits - 1})"
    return (f"(CASE WHEN ({expr}) = 0 THEN 0.0 WHEN {e} >= 0 THEN {r} * {p} "
            f"ELSE {r} / {p} END + 0.0)")
