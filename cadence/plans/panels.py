"""Panels built from the driver tables (TPC-H-like star schema + events).

Scale notes
* Every raw table is aggregated before it is joined: lineitem -> one row per
  order, orders -> one row per (customer, month).  Partial (map-side)
  aggregation collapses a hot key before any shuffle, so a customer or order
  holding a third of all rows costs one row per month after the combine.
* Joins are equi-joins on the aggregated keys; Catalyst/AQE pick broadcast
  only when the measured side is under ``spark.sql.autoBroadcastJoinThreshold``.
* Money is summed as BIGINT cents (revenue in 1e-4 units) and divided once at
  the end: exact and order independent like DECIMAL, but on the fast
  long-arithmetic path (DECIMAL sums past 18 digits fall back to BigDecimal).
  Bound: the largest group sum (revenue per priority-month at SF 100000) is
  ~6e17 < 9.2e18; ANSI mode raises on overflow instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.exprs import safe_div
from cadence.panel import Panel, densify, month_start

PA_METRICS = ("order_value", "order_count", "line_revenue", "line_qty", "avg_discount")
PB_METRICS = ("order_value", "order_count")
PC_METRICS = ("n", "value_sum", "users")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(c: str):
    """2-decimal amount -> exact integer cents."""
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


def money(c: str):
    """Exact 2-decimal amount kept as integer cents (sum, then ``dollars``)."""
    return cents(c)


def dollars(total, scale: float = 100.0):
    return total.cast("double") / scale


def lines_per_order(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per order, of ``orders`` alone if given.  Lines are aggregated
    first, with a map-side combine, so an order holding much of the table is
    one row per task before anything is shuffled; the semi-join then shares
    the partitioning on the order key."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(cents("l_extendedprice") * (F.lit(100) - cents("l_discount"))).alias("rev"),
        F.sum(cents("l_quantity")).alias("qty"),
        F.sum(cents("l_discount")).alias("disc"),
        F.count(F.lit(1)).alias("nl"),
    )
    if orders is not None:
        li = li.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return li


def build_pa(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> Panel:
    """PA: order priority x month with order and line metrics.  ``orders`` may
    be a pre-filtered orders frame (period range / membership pushed down)."""
    filtered = orders is not None
    o = orders if filtered else read(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_orderpriority", month_start("o_orderdate").alias("period"),
                 money("o_totalprice").alias("price"))
    li = lines_per_order(spark, sf_dir, o if filtered else None)
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    df = j.groupBy("o_orderpriority", "period").agg(
        dollars(F.sum("price")).alias("order_value"),
        F.count(F.lit(1)).cast("double").alias("order_count"),
        dollars(F.sum("rev"), 10000.0).alias("line_revenue"),
        dollars(F.sum("qty")).alias("line_qty"),
        safe_div(dollars(F.sum("disc")), F.sum("nl").cast("double")).alias("avg_discount"),
    )
    return Panel(df, ("o_orderpriority",), "period", PA_METRICS, "month")


def build_pb(spark: SparkSession, sf_dir: str, dense: bool = True) -> Panel:
    """PB: customer nation x month, densified on a spine so that nations and
    months without orders are real NULL rows.  Spine bounds are scalar
    subqueries over the orders table (no cross join)."""
    orders = read(spark, sf_dir, "orders")
    # a customer has a few orders, so aggregating them first would shuffle the
    # orders twice: join on the customer (a hot one is split by AQE's skew
    # join), then combine to (nation, month) before the second exchange
    pruned = orders.select("o_custkey", month_start("o_orderdate").alias("period"),
                           money("o_totalprice").alias("price"))
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = pruned.join(cust, pruned.o_custkey == cust.c_custkey, "inner")
    df = j.groupBy("c_nationkey", "period").agg(
        dollars(F.sum("price")).alias("order_value"),
        F.count(F.lit(1)).cast("double").alias("order_count"))
    if dense:
        nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
        m = month_start("o_orderdate")
        # one scalar subquery for both bounds (referenced twice, planned once)
        bounds = orders.select(F.struct(F.min(m).alias("lo"), F.max(m).alias("hi"))).scalar()
        df = densify(df, nations, ["c_nationkey"], "period", bounds.getField("lo"),
                     bounds.getField("hi"), "month")
    return Panel(df, ("c_nationkey",), "period", PB_METRICS, "month")


def build_pc(spark: SparkSession, sf_dir: str) -> Panel:
    """PC: event type x day: count, value sum, distinct users."""
    ev = read(spark, sf_dir, "events")
    df = ev.groupBy("event_type", F.col("ts").cast("date").alias("period")).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        dollars(F.sum(money("value"))).alias("value_sum"),
        F.countDistinct("user_id").cast("double").alias("users"))
    return Panel(df, ("event_type",), "period", PC_METRICS, "day")


# The interval categories derived for the error-event catalog.
EV_CATEGORIES = ("app", "network", "storage")


def build_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV: an interval catalog derived from error events: start = event day,
    end = start + (event_id % 3) days, severity 1..5, category by user."""
    ev = read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    start = F.col("ts").cast("date")
    cat = F.element_at(F.array(*[F.lit(c) for c in EV_CATEGORIES]),
                       (F.col("user_id") % 3 + 1).cast("int"))
    return ev.select(
        F.col("event_id"),
        start.alias("start"),
        F.date_add(start, (F.col("event_id") % 3).cast("int")).alias("end"),
        cat.alias("category"),
        (F.col("event_id") % 5 + 1).cast("int").alias("severity"),
        F.concat(F.lit("error #"), F.col("event_id").cast("string")).alias("title"),
        F.col("props").alias("description"),
        F.lit("events").alias("source"),
    )


# Knockout phase names by line number (lines 1-3 are the group stage).
PHASES = ("group", "group", "group", "round_of_16", "quarter_final", "semi_final", "final")


def build_sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC: a child fact table — one 'match' per line item, parent = order.
    Goals, phase and the opponent-history columns are derived from line
    attributes; strong/weak flags follow the scoring rules in ``scoring``."""
    li = read(spark, sf_dir, "lineitem")
    gf = (F.col("l_quantity").cast("int") % 5)
    gc = (F.round(F.col("l_tax") * 100).cast("int") % 4)
    phase = F.element_at(F.array(*[F.lit(p) for p in PHASES]),
                         F.least(F.col("l_linenumber"), F.lit(len(PHASES))).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("parent_id"),
        F.col("l_linenumber").cast("int").alias("match_no"),
        phase.alias("phase"),
        gf.alias("goals_for"),
        gc.alias("goals_against"),
        F.when(F.col("l_returnflag") == "R", (gf == gc).cast("int")).otherwise(0).alias("shootout_win"),
        (F.col("l_partkey") % 7 == 0).cast("int").alias("rival_titles"),
        (F.col("l_suppkey") % 4).cast("int").alias("rival_top4"),
        (F.col("l_suppkey") % 6).cast("int").alias("rival_appearances"),
        (F.col("l_partkey") % 3).cast("int").alias("rival_ko_wins"),
    )


def build_tx(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TX: documents (base) and labels (enrichment), with lineage columns."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.col("n_chars") >= 1000).cast("int").alias("quality"),
        F.col("source").alias("src_document"))
    labels = read(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label_quality"), "toxic",
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")).alias("label_note"),
        F.lit("labels").alias("src_label"))
    return docs, labels
