import pytest
from pyspark.sql import functions as F

from cadence.operators import enrich as E
from cadence.operators import project as P
from cadence.operators import quality as Q
from tests.conftest import rows


def test_numeric_and_infer(spark):
    df = spark.createDataFrame([("1", "x", " 2.5 "), ("2", "y", ".."), (None, "3", "4")],
                               "a string, b string, c string")
    inf = Q.infer_numeric(df, keep_text=["c"])
    assert dict(inf.dtypes) == {"a": "double", "b": "string", "c": "string"}
    num = Q.numeric(df, ["c", "missing"])
    assert [r[0] for r in num.select("c").collect()] == [2.5, None, 4.0]


def test_add_missing_and_drops(spark):
    df = spark.createDataFrame([(1, 1.0), (None, 2.0), (3, None)], "k int, v double")
    assert "share" in Q.add_missing(df, ["share", "v"]).columns
    assert Q.drop_null_keys(df, ["k"]).count() == 2
    assert Q.complete_cases(df, ["k", "v"]).count() == 1


def test_key_violations_and_guard(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(Q.key_violations(df, ["k"])) == [(1, 2)]
    with pytest.raises(ValueError):
        Q.assert_unique(df, ["k"])


def test_validated_join_rejects_duplicates_on_either_side(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, y string")
    with pytest.raises(Exception, match="duplicate key in enrichment"):
        E.validated_left_join(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="duplicate key in base"):
        E.validated_left_join(b, a, ["k"]).collect()
    ok = E.validated_left_join(a, spark.createDataFrame([(1, "p")], "k int, y string"), ["k"])
    assert rows(ok) == [(1, "a", "p"), (2, "b", None)]


def test_validated_join_with_null_keys(spark):
    """NULL keys repeat freely on both sides, match nothing and are not shuffled."""
    base = spark.range(0, 900, 1, 4).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS k", "CASE WHEN id % 6 = 0 THEN NULL ELSE 'p' END AS q", "id AS x")
    extra = spark.range(450).selectExpr("CASE WHEN id < 9 THEN NULL ELSE id END AS k", "'p' AS q", "id * 10 AS y", "map('a', id) AS m")
    out = E.validated_left_join(base, extra, ["k", "q"])
    assert out.columns == ["k", "q", "x", "y", "m"]
    got = {r.x: (r.k, r.q, r.y) for r in out.collect()}
    assert len(got) == 900
    for x, (k, q, y) in got.items():
        assert (k, q) == (None if x % 3 == 0 else x, None if x % 6 == 0 else "p")
        assert y == (10 * x if x % 3 and 9 <= x < 450 else None)
    spread = {r.p: r.n for r in out.where("k IS NULL").groupBy(F.spark_partition_id().alias("p")).count().withColumnRenamed("count", "n").collect()}
    assert len(spread) > 1 and max(spread.values()) < 300
    twice = base.where("k IS NOT NULL").unionByName(base.where("k = 4"))
    with pytest.raises(Exception, match="duplicate key in base"):
        E.validated_left_join(twice, extra, ["k", "q"]).collect()


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="missing"):
        Q.require_columns(df, ["a", "b"])


def test_domain_checks(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 3.0), (3, None)], "p int, v double")
    out = dict(Q.domain_checks(df, {"neg": F.col("v") < 0, "late": F.col("p") > 2}).collect())
    assert out == {"neg": 1, "late": 1}


def test_precedence_merge_and_money(spark):
    df = spark.createDataFrame([(1, "old", None, 10.0, 2.0, 0.0),
                                (2, "old", "new", 5.0, 4.0, 50.0)],
                               "k int, p string, e string, usd double, fx double, defl double")
    d = E.precedence(df, {"p": "e"})
    assert rows(d, "k", "p", "p_original") == [(1, "old", "old"), (2, "new", "old")]
    d = E.convert_currency(df, {"usd": "local"}, "fx")
    d = E.deflate(d, {"local": "real"}, "defl")
    assert rows(d, "k", "local", "real") == [(1, 20.0, None), (2, 20.0, 40.0)]
    d = E.add_total(E.per_capita(df, "pc", "usd", "defl"), "t", ["usd", "defl"])
    assert rows(d, "k", "pc", "t") == [(1, None, 10.0), (2, 0.1, 55.0)]


def test_membership_and_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "c string, n int")
    assert P.membership(df, "c", []).count() == 3          # empty selection = no filter
    assert P.membership(df, "c", ["a", None]).count() == 1  # NULL never matches
    assert P.membership(df, "c", df.select("c").where("n < 3")).count() == 2
    assert P.all_of(df, F.col("n") > 1, F.col("c") == "b").count() == 1
    assert P.period_range(df, "n", 2, 3).count() == 2


def test_trend_offset_months(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2000, 11, 1)), ("a", dt.date(2001, 2, 1))],
                               "k string, period date")
    assert [r[0] for r in P.trend_offset(df, ["k"], "period", "month").orderBy("period")
            .select("trend").collect()] == [0, 3]
