"""Registered queries: sources/sinks (S), typing and contracts (T),
projections and filters (P)."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.exprs import NUMBER_PATTERN, to_number
from cadence.operators import enrich as E
from cadence.operators import project as P
from cadence.operators import quality as Q
from cadence.panel import to_long
from cadence.plans import sql as S
from cadence.plans.panels import (PA_METRICS, build_ev, build_pa, build_pb, build_sc, build_tx,
                                  dollars, money, read)
from cadence.plans.registry import register
from cadence.session import scratch_path
from cadence.sources import files as SRC
from cadence.sources import indicators as IND


def num_sql(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim(CAST({x} AS VARCHAR)), '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END")


# ------------------------------------------------------------------ S: sources
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@register("s01_csv_scan", "SELECT event_id, user_id, ts, event_type, value, props FROM events")
def s01_csv_scan(spark, sf):
    """Events written as CSV (quoted JSON text with commas and quotes)
    to the shared scratch folder and scanned back with an explicit schema."""
    path = scratch_path(spark, "s01_events_csv")
    SRC.write_csv(read(spark, sf, "events").select(*EVENT_SCHEMA.fieldNames()), path)
    return SRC.read_csv(spark, path, EVENT_SCHEMA, multi_line=False)


# External indicator codes of the yearly nation metrics.
SERIES_CODES = {"order_value": "OV.TOT", "order_count": "OC.TOT"}


def yearly_nation_long(spark, sf):
    orders = read(spark, sf, "orders")
    pruned = orders.select("o_custkey", F.year("o_orderdate").alias("year"), money("o_totalprice").alias("v"))
    cust = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    by_nation = (pruned.join(cust, pruned.o_custkey == cust.c_custkey)
                 .groupBy("c_nationkey", "year")
                 .agg(dollars(F.sum("v")).alias("order_value"),
                      F.count(F.lit(1)).cast("double").alias("order_count")))
    nation = read(spark, sf, "nation")
    named = by_nation.join(nation, by_nation.c_nationkey == nation.n_nationkey)
    long = to_long(named.select("n_name", "n_nationkey", "year", "order_value", "order_count"),
                   ["n_name", "n_nationkey"], "year", list(SERIES_CODES))
    code = F.create_map(*[x for kv in SERIES_CODES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return long.select(F.col("metric").alias("Series Name"), code[F.col("metric")].alias("Series Code"),
                       F.col("n_name").alias("Country Name"),
                       F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("Country Code"),
                       "year", "value")


def wide_indicators(spark, sf):
    """The yearly nation metrics as a wide table, a column for each year from
    the first order's to the last one's."""
    y = F.year("o_orderdate")
    first, last = read(spark, sf, "orders").select(F.min(y), F.max(y)).first()
    years = list(range(first, last + 1)) if first is not None else []
    return IND.pivot_indicators(yearly_nation_long(spark, sf), list(IND.ID_COLUMNS), "year", "value", years)


def _yearly_sql() -> str:
    return """
yn AS (
  SELECT n_name, n_nationkey, year,
         CAST(SUM(v) AS DOUBLE) / 100.0 AS order_value, CAST(SUM(c) AS DOUBLE) AS order_count
  FROM (SELECT o_custkey, year(o_orderdate) AS year, SUM(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS v,
               COUNT(*) AS c FROM orders GROUP BY 1, 2) pc
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
ind AS (
  SELECT 'order_value' AS series_name, 'OV.TOT' AS series_code, n_name AS country_name,
         'N' || CAST(n_nationkey AS VARCHAR) AS country_code, CAST(year AS INTEGER) AS year,
         order_value AS value FROM yn
  UNION ALL
  SELECT 'order_count', 'OC.TOT', n_name, 'N' || CAST(n_nationkey AS VARCHAR),
         CAST(year AS INTEGER), order_count FROM yn)"""


IND_SQL = _yearly_sql()


@register("s02_indicator_melt", S.with_(IND_SQL) + "SELECT * FROM ind WHERE value IS NOT NULL")
def s02_indicator_melt(spark, sf):
    """Yearly nation metrics pivoted into a wide indicator table (one
    '1995 [YR1995]' text column per year, '..' when missing) and melted back."""
    return IND.melt_indicators(wide_indicators(spark, sf))


LABEL_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                             T.StructField("quality", T.IntegerType()),
                             T.StructField("toxic", T.IntegerType())])


@register("s03_optional_source", "SELECT doc_id, quality, toxic FROM labels")
def s03_optional_source(spark, sf):
    """S3: optional source with a column contract: the labels table is
    present and complete; an absent companion file contributes nothing."""
    present = SRC.optional_source(spark, f"{sf}/labels.parquet", ["doc_id", "quality", "toxic"],
                                  LABEL_SCHEMA)
    absent = SRC.optional_source(spark, f"{sf}/labels_missing.parquet", ["doc_id"], LABEL_SCHEMA)
    return present.unionByName(absent)


@register("s04_interval_catalog", S.with_(S.EV) + "SELECT * FROM ev")
def s04_interval_catalog(spark, sf):
    """Interval catalog scan: coercion, NULL start dropped."""
    return SRC.load_intervals(build_ev(spark, sf))


@register("s05_fact_scan", S.with_(S.SC) + """
SELECT CAST(parent_id AS BIGINT) AS key, parent_id, match_no, phase,
       CAST(goals_for AS DOUBLE) AS goals_for, CAST(goals_against AS DOUBLE) AS goals_against,
       shootout_win, rival_titles, rival_top4, rival_appearances, rival_ko_wins FROM sc""")
def s05_fact_scan(spark, sf):
    """Fact scan whose key may be named 'tournament_id' or 'parent_id';
    listed numeric columns are coerced."""
    return SRC.load_facts(build_sc(spark, sf), ["tournament_id", "parent_id"],
                          ["goals_for", "goals_against", "not_there"])


@register("s06_write_report", S.with_(S.PA_WIDE) + """
SELECT COUNT(*) AS n_rows, CAST(8 AS INTEGER) AS n_cols, MIN(period) AS min_period,
       MAX(period) AS max_period FROM pa""")
def s06_write_report(spark, sf):
    """The consolidated PA panel written as Parquet partitioned by year,
    reported back from disk (rows, columns, period range)."""
    pa = build_pa(spark, sf).df.withColumn("year", F.year("period"))
    return SRC.write_table(pa, scratch_path(spark, "s06_pa"), ["year"])


# ------------------------------------------------------------------ T: typing / contracts
KEXTRACT = r'"k":\s*([^},]*)'


@register("t01_numeric_coercion", f"""
SELECT event_id, {num_sql(f"regexp_extract(props, '{KEXTRACT}', 1)")} AS k_num,
       {num_sql("event_type")} AS type_num, {num_sql("' ' || CAST(value AS VARCHAR) || ' '")} AS value_num
FROM events""")
def t01_numeric_coercion(spark, sf):
    """Text -> number with unparsable values as NULL (JSON field text,
    category names, padded numbers)."""
    ev = read(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", KEXTRACT, 1).alias("k_num"),
        F.col("event_type").alias("type_num"),
        F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")).alias("value_num"))
    return Q.numeric(ev, ["k_num", "type_num", "value_num", "absent_col"])


@register("t02_numeric_inference", """
SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(user_id AS DOUBLE) AS user_id,
       CAST(value AS DOUBLE) AS value, event_type, props FROM events""")
def t02_numeric_inference(spark, sf):
    """All-or-nothing numeric inference over an all-text events table."""
    ev = read(spark, sf, "events").select(*[F.col(c).cast("string") for c in
                                            ("event_id", "user_id", "value", "event_type", "props")])
    return Q.infer_numeric(ev, keep_text=["props"])


@register("t03_reserved_columns", S.with_(S.PA_WIDE) + """
SELECT *, CAST(NULL AS DOUBLE) AS extra_index, CAST(NULL AS DOUBLE) AS extra_pct FROM pa""")
def t03_reserved_columns(spark, sf):
    """Reserved metric columns added as NULL when absent."""
    return Q.add_missing(build_pa(spark, sf).df, ["extra_index", "extra_pct", "order_value"])


@register("t04_drop_null_keys", S.with_(S.TX) + """
SELECT d.doc_id, lang, label_quality FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id
WHERE label_quality IS NOT NULL""")
def t04_drop_null_keys(spark, sf):
    """T4: rows with a NULL key (documents without a label) are dropped."""
    docs, labels = build_tx(spark, sf)
    j = docs.join(labels, "doc_id", "left").select("doc_id", "lang", "label_quality")
    return Q.drop_null_keys(j, ["label_quality"])


@register("t05_complete_cases", S.with_(S.PB_WIDE) + """
SELECT * FROM pb WHERE order_value IS NOT NULL AND order_count IS NOT NULL""")
def t05_complete_cases(spark, sf):
    """T5: complete cases of the densified PB panel."""
    return Q.complete_cases(build_pb(spark, sf).df, ["order_value", "order_count"])


@register("t06_nonfinite_to_null", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN isfinite(l_extendedprice / NULLIF(l_quantity, 0))
            THEN l_extendedprice / NULLIF(l_quantity, 0) END AS unit_price
FROM lineitem""")
def t06_nonfinite_to_null(spark, sf):
    """Derived ratios cleaned of NaN / infinity."""
    li = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"))
    return Q.nonfinite_to_null(li, ["unit_price"])


@register("t07_key_violations", """
SELECT l_orderkey, COUNT(*) AS count FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1""")
def t07_key_violations(spark, sf):
    """Keys that break a one-to-one contract (lineitem by order)."""
    return Q.key_violations(read(spark, sf, "lineitem"), ["l_orderkey"])


@register("t08_required_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def t08_required_columns(spark, sf):
    """Required-column contract (plan-time), then the contracted columns."""
    o = Q.require_columns(read(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"],
                          "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus")


T09_RULES_SQL = [
    ("period_before_1995", "period < DATE '1995-01-01'"),
    ("period_after_2001", "period > DATE '2001-12-01'"),
    ("negative_order_value", "order_value < 0"),
    ("nonpositive_order_count", "order_count <= 0"),
    ("missing_line_revenue", "line_revenue IS NULL"),
]


@register("t09_domain_checks", S.with_(S.PA_WIDE) + "\nUNION ALL\n".join(
    f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE {c}) AS violations FROM pa"
    for n, c in T09_RULES_SQL))
def t09_domain_checks(spark, sf):
    """Domain rules on the PA panel, one aggregate, (rule, violations)."""
    pa = build_pa(spark, sf).df
    return Q.domain_checks(pa, {n: F.expr(c) for n, c in T09_RULES_SQL})


@register("t10_default_fill", S.with_(S.TX) + """
SELECT d.doc_id, COALESCE(NULLIF(trim(label_note), ''), 'no note') AS label_note
FROM docs d LEFT JOIN labs l ON d.doc_id = l.doc_id""")
def t10_default_fill(spark, sf):
    """NULL or blank text replaced by a default label."""
    docs, labels = build_tx(spark, sf)
    j = docs.join(labels, "doc_id", "left").select("doc_id", "label_note")
    return Q.default_fill(j, ["label_note"], "no note")


# ------------------------------------------------------------------ P: projections
@register("p01_select_existing",
          "SELECT o_orderkey AS order_id, o_custkey, o_orderstatus FROM orders")
def p01_select_existing(spark, sf):
    """Explicit column list intersected with existing columns, key renamed."""
    return P.select_existing(read(spark, sf, "orders"),
                             ["o_orderkey", "o_custkey", "o_orderstatus", "o_not_a_column"],
                             {"o_orderkey": "order_id"})


def pa_money(spark, sf):
    pa = build_pa(spark, sf).df
    return pa.withColumns({"fx_rate": 1 + F.col("avg_discount"),
                           "deflator": 100 * (1 - F.col("avg_discount"))})


PA_MONEY_SQL = S.PA_WIDE + """,
pam AS (SELECT *, 1 + avg_discount AS fx_rate, 100 * (1 - avg_discount) AS deflator FROM pa)"""


@register("p02_currency", S.with_(PA_MONEY_SQL) + """
SELECT o_orderpriority, period, order_value * fx_rate AS order_value_fx,
       line_revenue * fx_rate AS line_revenue_fx FROM pam""")
def p02_currency(spark, sf):
    """Currency conversion of money flows by a per-period rate."""
    d = E.convert_currency(pa_money(spark, sf), {"order_value": "order_value_fx",
                                                 "line_revenue": "line_revenue_fx"}, "fx_rate")
    return d.select("o_orderpriority", "period", "order_value_fx", "line_revenue_fx")


def _defl(x: str) -> str:
    e = f"{x} / NULLIF(deflator / 100, 0)"
    return f"CASE WHEN isfinite({e}) THEN {e} END"


@register("p03_deflate", S.with_(PA_MONEY_SQL) + f"""
SELECT o_orderpriority, period, {_defl('order_value')} AS order_value_real,
       {_defl('line_revenue')} AS line_revenue_real FROM pam""")
def p03_deflate(spark, sf):
    """Deflation to constant prices: nominal / (index / 100)."""
    d = E.deflate(pa_money(spark, sf), {"order_value": "order_value_real",
                                        "line_revenue": "line_revenue_real"}, "deflator")
    return d.select("o_orderpriority", "period", "order_value_real", "line_revenue_real")


@register("p04_totals", S.with_(S.PA_WIDE) + """
SELECT o_orderpriority, period, order_value + line_revenue AS total_value,
       order_value / NULLIF(order_count, 0) AS value_per_order FROM pa""")
def p04_totals(spark, sf):
    """Additive total (NULL-propagating) and a per-unit ratio."""
    d = E.add_total(build_pa(spark, sf).df, "total_value", ["order_value", "line_revenue"])
    d = E.per_capita(d, "value_per_order", "order_value", "order_count")
    return d.select("o_orderpriority", "period", "total_value", "value_per_order")


@register("p05_lineage_literals", S.with_(S.PA_WIDE) + """
SELECT o_orderpriority, period, 'panel-v1' AS panel_version,
       'orders + lineitem, monthly' AS panel_note FROM pa""")
def p05_lineage_literals(spark, sf):
    """P5: version and lineage literal columns on the consolidated panel."""
    d = P.with_literals(build_pa(spark, sf).df, {"panel_version": "panel-v1",
                                                 "panel_note": "orders + lineitem, monthly"})
    return d.select("o_orderpriority", "period", "panel_version", "panel_note")


# The metric catalog of the PA panel (label, column, real column,
# unit, real unit, description).
CATALOG = [
    ("ORDER VALUE", "order_value", "order_value_real", "USD", "USD constant", "sum of order prices"),
    ("ORDERS", "order_count", None, "orders", None, "number of orders"),
    ("LINE REVENUE", "line_revenue", "line_revenue_real", "USD", "USD constant", "discounted line revenue"),
    ("QUANTITY", "line_qty", None, "units", None, "line quantity"),
    ("DISCOUNT", "avg_discount", None, "rate %", None, "mean line discount"),
]
CATALOG_SCHEMA = ("label string, column string, real_column string, unit string, "
                  "real_unit string, description string")


def catalog_df(spark):
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA)


def _catalog_values_sql() -> str:
    def q(v):
        return "NULL" if v is None else "'" + v + "'"
    rows = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in CATALOG)
    return (f"cat AS (SELECT * FROM (VALUES {rows}) AS t(label, \"column\", real_column, unit, "
            f"real_unit, description))")


REAL_METRICS = ["order_value_real", "line_revenue_real"]


REAL_SQL = [PA_MONEY_SQL, f"""
pr AS (SELECT *, {_defl('order_value')} AS order_value_real, {_defl('line_revenue')} AS line_revenue_real FROM pam)""",
            S.long_cte("prl", "pr", ["o_orderpriority"], list(PA_METRICS) + REAL_METRICS), _catalog_values_sql()]


def resolved(spark, sf, use_real):
    d = E.deflate(pa_money(spark, sf), {"order_value": "order_value_real",
                                        "line_revenue": "line_revenue_real"}, "deflator")
    metrics = list(PA_METRICS) + REAL_METRICS
    long = to_long(d, ["o_orderpriority"], "period", metrics)
    return P.resolve_metrics(long, catalog_df(spark), metrics, use_real=use_real)


@register("p06_metric_resolution", S.with_(*REAL_SQL) + """
SELECT prl.o_orderpriority, prl.period, prl.value, cat.label,
       CASE WHEN real_column IS NOT NULL THEN real_column ELSE "column" END AS "column",
       CASE WHEN real_column IS NOT NULL THEN COALESCE(real_unit, unit) ELSE unit END AS unit,
       real_column IS NOT NULL AS used_real
FROM prl JOIN cat ON prl.metric = CASE WHEN real_column IS NOT NULL THEN real_column ELSE "column" END""")
def p06_metric_resolution(spark, sf):
    """Catalog labels resolved to real-terms series where available
    (broadcast catalog join), with unit and used-real flag."""
    return resolved(spark, sf, True)


@register("p06_metric_resolution_original", S.with_(*REAL_SQL) + """
SELECT prl.o_orderpriority, prl.period, prl.value, cat.label, "column", unit, false AS used_real
FROM prl JOIN cat ON prl.metric = cat."column" """)
def p06_metric_resolution_original(spark, sf):
    """Catalog labels resolved to their original series."""
    return resolved(spark, sf, False)


@register("p07_period_range", S.with_(S.PA_WIDE) + """
SELECT * FROM pa WHERE period BETWEEN DATE '1997-01-01' AND DATE '1998-12-01'""")
def p07_period_range(spark, sf):
    """Inclusive period range, pushed into the orders Parquet scan."""
    o = read(spark, sf, "orders")
    lo = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit("1998-12-31 23:59:59").cast("timestamp_ntz")
    o = P.period_range(o, "o_orderdate", lo, hi)
    return build_pa(spark, sf, orders=o).df


@register("p08_membership", S.with_(S.PA_WIDE) + """
SELECT * FROM pa WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def p08_membership(spark, sf):
    """Multi-select membership filter (empty selection = no filter)."""
    o = P.membership(read(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return build_pa(spark, sf, orders=P.membership(o, "o_orderpriority", [])).df


@register("p10_nonblank_text", """
SELECT conv_id, turn, role, text FROM conversations WHERE length(trim(text)) > 0""")
def p10_nonblank_text(spark, sf):
    """P10: rows whose text is not blank."""
    return P.nonblank_rows(read(spark, sf, "conversations"), "text").select("conv_id", "turn", "role", "text")


@register("p12_trend_offset", S.with_(S.PB_WIDE) + """
SELECT c_nationkey, period, date_diff('month', MIN(period) OVER (PARTITION BY c_nationkey), period) AS trend
FROM pb""")
def p12_trend_offset(spark, sf):
    """Trend regressor = periods since the series' first period."""
    d = P.trend_offset(build_pb(spark, sf).df, ["c_nationkey"], "period", "month")
    return d.select("c_nationkey", "period", "trend")


@register("s06_partition_read", S.with_(S.PA_WIDE) + """
SELECT *, CAST(year(period) AS INTEGER) AS year FROM pa WHERE year(period) BETWEEN 1997 AND 1998""")
def s06_partition_read(spark, sf):
    """S6 read side: the PA panel written partitioned by year, read back for
    1997-1998 through partition pruning (only two directories are listed)."""
    pa = build_pa(spark, sf).df.withColumn("year", F.year("period"))
    path = scratch_path(spark, "s06_pa_read")
    SRC.write_table(pa, path, ["year"])
    return SRC.read_partitions(spark, path, "year", 1997, 1998)


@register("b01_consolidated_build", S.with_(PA_MONEY_SQL) + f"""
SELECT o_orderpriority, period, ov AS order_value, order_value AS order_value_original, line_revenue, order_count,
       CASE WHEN month(period) = 3 THEN 'orders | revised' ELSE 'orders' END AS source, 'orders' AS source_original,
       ov * fx_rate AS order_value_fx, line_revenue * fx_rate AS line_revenue_fx,
       CASE WHEN month(period) <= 2 THEN 42.0::DOUBLE ELSE {_defl('ov')} END AS order_value_real,
       {_defl('line_revenue')} AS line_revenue_real, ov + line_revenue AS total_value,
       ov / NULLIF(order_count, 0) AS value_per_order, 'panel-v2' AS panel_version
FROM (SELECT *, CASE WHEN month(period) = 6 THEN order_value + 1 ELSE order_value END AS ov FROM pam)""")
def b01_consolidated_build(spark, sf):
    """The whole build: CSV scan, number coercion, validated join to the
    enrichment (with an audited real column), precedence, text merge, currency,
    deflation, totals, version literal, sort, write and read back."""
    raw, out = scratch_path(spark, "b01_raw"), scratch_path(spark, "b01_table")
    keys, numbers = ["o_orderpriority", "period"], ["order_value", "line_revenue", "order_count"]
    money_panel = pa_money(spark, sf)
    SRC.write_csv(money_panel.select(*keys, *numbers), raw)
    base = SRC.read_csv(spark, raw, multi_line=False)
    base = base.withColumns({c: to_number(c) for c in numbers}).withColumns(
        {"period": F.col("period").cast("date"), "source": F.lit("orders")})
    month = F.month("period")
    extra = money_panel.select(
        *keys, "fx_rate", "deflator", F.when(month == 6, F.col("order_value") + 1).alias("new_value"),
        F.when(month <= 2, F.lit(42.0)).alias("order_value_real"), F.when(month == 3, F.lit("revised")).alias("note"))
    d = E.precedence(E.validated_left_join(base, extra, keys), {"order_value": "new_value"})
    d = E.merge_text(d, "source", "note")
    d = E.convert_currency(d, {"order_value": "order_value_fx", "line_revenue": "line_revenue_fx"}, "fx_rate")
    d = E.deflate(d, {"order_value": "order_value_real", "line_revenue": "line_revenue_real"}, "deflator")
    d = E.add_total(d, "total_value", ["order_value", "line_revenue"])
    d = E.per_capita(d, "value_per_order", "order_value", "order_count")
    d = P.with_literals(d, {"panel_version": "panel-v2"}).drop("fx_rate", "deflator", "new_value", "note")
    SRC.write_table(d.orderBy(*keys), out)
    return spark.read.parquet(out)
