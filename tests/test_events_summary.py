import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cadence.operators import compare as C
from cadence.operators import events as EV
from cadence.operators import scoring as SC
from cadence.operators import summary as A
from cadence.plans import q_joins as J
from tests.conftest import rows

EV_SCHEMA = "event_id int, start int, `end` int, category string, severity int"


def events(spark):
    return spark.createDataFrame([(1, 2000, 2002, "c", 3), (2, 2005, None, "c", 2),
                                  (3, 2001, 2001, "d", 5), (4, 2001, 2001, "c", 1)], EV_SCHEMA)


def test_overlap_null_end_and_categories(spark):
    ev = events(spark)
    assert sorted(r[0] for r in EV.overlapping(ev, 2001, 2010).select("event_id").collect()) == [1, 3, 4]
    assert EV.overlapping(ev, 2001, 2010, categories=[]).count() == 0
    got = EV.overlapping(ev, 2001, 2010, categories=["c"], severity=(2, 5))
    assert [r[0] for r in got.select("event_id").collect()] == [1]


def test_overlay_and_event_study(spark):
    ev = events(spark)
    panel = spark.createDataFrame([("x", y, float(v)) for y, v in
                                   [(1999, 0.0), (2000, 2.0), (2001, 4.0), (2002, 8.0), (2003, 4.0)]],
                                  "k string, period int, value double")
    ov = EV.overlay(ev, panel, "year")  # one series
    assert sorted(r[0] for r in ov.where("event_id = 1").select("period").collect()) == [2000, 2001, 2002]
    assert ov.where("event_id IN (3, 4)").count() == 2     # two intervals over the same period
    st = {r[0]: r for r in EV.event_study(ev, panel, ["k"], "year", [("x",)]).collect()}
    e1 = st[1]
    assert (e1.before, e1.during, e1.after) == (0.0, 8.0, 4.0)
    assert e1.change_before_during_pct is None              # zero base
    assert math.isclose(e1.change_during_after_pct, -50.0)
    assert st[2].during is None and st[2].after is None     # NULL end: listed, without them
    far = spark.createDataFrame([(9, 2050, 2051), (10, 1990, 9_999_999)], "event_id int, start int, end int")
    assert [(r.event_id, r.k, r.before) for r in EV.event_study(far.where("event_id = 9"), panel, ["k"], "year", [("x",)]).collect()] == [(9, "x", None)]
    assert EV.overlay(far, panel, "year").count() == 5      # open end: clipped to the panel


def test_event_study_lists_every_event_and_selected_series(spark):
    ev = spark.createDataFrame([(1, 2000, 2000), (2, 1990, 1990)], "event_id int, start int, end int")
    panel = spark.createDataFrame([("a", y, 1.0 * y) for y in (1999, 2000, 2001)] + [("b", 1990, 5.0), ("b", 1991, 6.0), ("z", 2000, 7.0), (None, 2000, 8.0)],
                                  "k string, period int, value double")
    st = {(r.event_id, r.k): (r.before, r.during, r.after) for r in EV.event_study(ev, panel, ["k"], "year", [("a",), ("b",), ("gone",), (None,)]).collect()}
    assert st == {(1, "a"): (1999.0, 2000.0, 2001.0), (1, "b"): (None, None, None), (2, "a"): (None, None, None), (2, "b"): (None, 5.0, 6.0),
                  (1, "gone"): (None, None, None), (2, "gone"): (None, None, None), (1, None): (None, 8.0, None), (2, None): (None, None, None)}
    assert EV.event_study(ev, panel, ["k"], "year", [("a",)]).count() == 2


def test_overlay_of_selected_series(spark):
    ev = spark.createDataFrame([(1, 2000, 2001)], "event_id int, start int, end int")
    panel = spark.createDataFrame([(k, y, 1.0) for k in "abc" for y in (1999, 2000, 2001)], "k string, period int, value double")
    got = EV.overlay(ev, panel, "year", keys=["k"], series=[("a",), ("c",)])
    assert sorted(rows(got, "k", "period")) == [("a", 2000), ("a", 2001), ("c", 2000), ("c", 2001)]
    assert EV.overlay(ev, panel, "year", keys=["k"], series=[]).count() == 0
    with pytest.raises(Exception, match="select the series"):
        EV.overlay(ev, panel, "year").collect()


def test_overlay_of_every_series(spark):
    ev = spark.createDataFrame([(1, 2000, 2001), (2, 2001, 2001), (2, 2001, 2001), (3, 2002, 2001), (4, 2001, None)], "event_id int, start int, end int")
    panel = spark.createDataFrame([(k, m, y, 1.0) for k in ("a", "b", None) for m in ("n", "users") for y in (1999, 2000, 2001)] + [("late", "n", 2001, None)],
                                  "k string, m string, period int, value double")
    got = EV.overlay(ev, panel, "year", keys=["k", "m"])
    want = [(e, y, k, m) for e, y in [(1, 2000), (1, 2001), (2, 2001), (2, 2001)] for k in ("a", "b", None) for m in ("n", "users")]
    want += [(e, 2001, "late", "n") for e in (1, 2, 2)]
    assert sorted(rows(got, "event_id", "period", "k", "m"), key=str) == sorted(want, key=str)


def test_overlay_query_covers_the_whole_panel(spark, tmp_path):
    types = ("click", "error", "purchase")
    recs = [(i, f"2024-01-0{1 + d} 05:00:00", t, 1.0 * i, i, "p") for i, (d, t) in enumerate((d, t) for d in range(4) for t in types)]
    recs += [(100, None, "error", 1.0, 1, "p"), (None, "2024-01-01 00:00:00", "error", 1.0, 1, "p")]
    table = spark.createDataFrame(recs, "event_id long, ts string, event_type string, value double, user_id long, props string")
    table.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "events.parquet"))
    got = rows(J.j05_interval_overlay(spark, str(tmp_path)), "event_id", "period", "event_type", "metric")
    starts = {i: d for i, d in ((1, 0), (4, 1), (7, 2), (10, 3))}
    want = [(i, dt.date(2024, 1, 1 + x), t, m) for i, d in starts.items() for x in range(d, min(d + i % 3, 3) + 1)
            for t in types for m in ("n", "value_sum", "users")]
    assert sorted(got) == sorted(want)


def test_trend_summary_cagr_guard(spark):
    df = spark.createDataFrame([("a", 2000, 100.0), ("a", 2002, 121.0), ("n", 2000, -1.0),
                                ("n", 2001, 2.0), ("z", 2000, 0.0), ("z", 2001, 3.0),
                                ("one", 2000, 1.0)], "metric string, period int, value double")
    out = {r.metric: r for r in A.trend_summary(df, ["metric"], "period", "value", "year").collect()}
    assert math.isclose(out["a"].cagr_pct, 10.0) and math.isclose(out["a"].total_change_pct, 21.0)
    assert out["n"].cagr_pct is None
    assert out["z"].total_change_pct is None
    assert "one" not in out


def test_coverage_and_first_last(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 6.0), ("a", 4, None),
                                ("e", 1, None)], "metric string, period int, value double")
    cov = {r[0]: tuple(r[1:]) for r in A.coverage(df, ["metric"]).collect()}
    assert cov == {"a": (2, 2, 3), "e": (0, None, None)}
    fl = A.first_last(df, ["metric"]).where("metric = 'a'").collect()[0]
    assert (fl.first_period, fl.first_value, fl.last_period, fl.last_value) == (2, 5.0, 3, 6.0)


def test_lineage_distinct_bounds_mixed_units(spark):
    df = spark.createDataFrame([(" s1 ", "x", 1.0, "USD"), ("s1", "", float("nan"), "%"),
                                (None, "y", 3.0, "USD")],
                               "src_a string, src_b string, v double, unit string")
    assert rows(A.lineage(df, "src_")) == [("src_a", "s1"), ("src_b", "x"), ("src_b", "y")]
    b = A.bounds(df, "v").collect()[0]
    assert (b.min_value, b.max_value, b.span) == (1.0, 3.0, 2.0)
    assert A.mixed_units(df, "unit").count() == 1
    assert [r[0] for r in A.distinct_values(df, "unit", ["%"]).collect()] == ["USD"]


def test_observed_bridge(spark):
    df = spark.createDataFrame([("a", y, float(y)) for y in range(1, 6)] +
                               [("b", 1, 1.0), ("b", 2, 2.0)], "k string, period int, v double")
    out = C.observed_bridge(df, ["k"], "period", "v", 3)
    after_a = sorted(r[0] for r in out.where("k='a' AND segment='after'").select("period").collect())
    assert after_a == [3, 4, 5]                              # bridge row = last training point
    assert out.where("k='b' AND segment='after'").count() == 0


def test_scoring_formula(spark):
    m = spark.createDataFrame([
        (1, 1, "group", 2, 0, 0, 1, 0, 5, 1),       # win vs strong (titles)
        (1, 2, "group", 0, 1, 0, 0, 0, 1, 0),       # loss vs weak
        (1, 3, "round_of_16", 1, 1, 1, 0, 0, 5, 1), # knockout draw won on shoot-out
    ], "parent_id long, match_no int, phase string, goals_for int, goals_against int, "
       "shootout_win int, rival_titles int, rival_top4 int, rival_appearances int, rival_ko_wins int")
    s = SC.parent_scores(m).collect()[0]
    # goal diff 1, wins 2, phases passed = 2 - 1 + 1, ko wins 1, strong wins 1, weak losses 1
    assert (s.goal_diff, s.wins, s.phases_passed, s.ko_wins) == (1, 2, 2, 1)
    assert math.isclose(s.score_total, 1 + 2 * 2 + 3 * 2 + 4 * 1 + 0.3 - 0.2)
    assert math.isclose(s.score_per_match, s.score_total / 3)
