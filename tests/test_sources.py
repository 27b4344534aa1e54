import pytest
import os

from pyspark.sql import types as T

from cadence.sources import files as SRC
from cadence.sources import indicators as IND
from tests.conftest import rows


def test_csv_bom_and_quoted_commas(spark, tmp_path):
    p = tmp_path / "events.csv"
    p.write_bytes('﻿start,end,category,severity,title,description\n'
                  '1994,1995,"Crisis, financial",5,Peso,"devaluation, ""tequila"" effect"\n'
                  '2020,,Pandemic,4,Covid,\n'
                  ',2001,Trade,2,NoStart,x\n'.encode("utf-8"))
    df = SRC.read_csv(spark, str(p))
    assert df.columns[0] == "start"
    got = rows(df, "category", "description", order=["title"])
    assert ("Crisis, financial", 'devaluation, "tequila" effect') in got
    cat = SRC.load_intervals(df)
    assert sorted(r[0] for r in cat.select("start").collect()) == [1994, 2020]
    assert "Sort" not in cat._jdf.queryExecution().executedPlan().toString()


def test_optional_source(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert SRC.optional_source(spark, str(tmp_path / "nope"), ["a"], schema).count() == 0
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "x")], "a long, c string").write.parquet(path)
    assert SRC.optional_source(spark, path, ["a", "b"], schema).count() == 0
    got = SRC.optional_source(spark, path, ["a"], schema)
    assert rows(got) == [(1, None)]


def test_melt_indicators(spark):
    wide = spark.createDataFrame(
        [("GDP", "G.1", "Alpha", "ALP", "1.5", ".."), ("GDP", "G.1", "Beta", "BET", "x", "2")],
        "`Series Name` string, `Series Code` string, `Country Name` string, "
        "`Country Code` string, `1990 [YR1990]` string, `1991 [YR1991]` string")
    got = rows(IND.melt_indicators(wide), "country_code", "year", "value")
    assert got == [("ALP", 1990, 1.5), ("BET", 1991, 2.0)]
    missing = wide.drop("Country Code")
    assert IND.melt_indicators(missing).count() == 0


def test_load_facts_key_candidates(spark):
    df = spark.createDataFrame([("7", "3"), ("8", "x")], "anio string, goals string")
    out = SRC.load_facts(df, ["year", "anio"], ["goals"])
    assert rows(out, "key", "goals") == [(7, 3.0), (8, None)]
    empty = SRC.load_facts(df, ["nope"], [])
    assert empty.count() == 0 and "key" in empty.columns
    odd = spark.createDataFrame([("1995.5",), ("99999999999999999999",), ("12",)], "year string")
    assert sorted(rows(SRC.load_facts(odd, ["year"], []), "key"), key=str) == [(12,), (None,), (None,)]


def test_quoted_line_break_and_bad_cells(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,note,n\n1,"line one\nline two",5\n2,plain,6\n')
    assert rows(SRC.read_csv(spark, str(p), "id int, note string, n int")) == [(1, "line one\nline two", 5), (2, "plain", 6)]
    p.write_text("id,note,n\n1,a,x\n2,b,6\n")
    with pytest.raises(Exception):
        SRC.read_csv(spark, str(p), "id int, note string, n int").collect()
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType())])
    assert rows(SRC.optional_source(spark, str(p), ["id"], schema, "csv")) == [(1, None), (2, 6)]


def test_write_table_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (3, "b")], "period int, k string")
    rep = SRC.write_table(df, str(tmp_path / "out"), ["k"]).collect()[0]
    assert (rep.n_rows, rep.n_cols, rep.min_period, rep.max_period) == (2, 2, 1, 3)
    assert os.path.isdir(tmp_path / "out" / "k=a")


def test_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([(y, float(y)) for y in range(1995, 2002)], "year int, v double")
    path = str(tmp_path / "panel")
    SRC.write_table(df, path, ["year"], period="year")
    part = SRC.read_partitions(spark, path, "year", 1997, 1998)
    assert sorted(r.year for r in part.collect()) == [1997, 1998]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "1997" in plan


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    SRC.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "period int, k string"), path)
    bad = spark.range(1, 5).selectExpr("CAST(id AS int) AS period", "CASE WHEN id = 4 THEN raise_error('no') ELSE 'c' END AS k")
    for options in ({}, {"partition_by": ["k"], "replace": "partitions"}):
        with pytest.raises(Exception):
            SRC.write_table(bad, path, **options)
        assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    assert sorted(os.listdir(tmp_path)) == ["t"]
    # a table may be written from itself
    more = spark.read.parquet(path).selectExpr("period + 10 AS period", "k")
    assert SRC.write_table(more, path).first().max_period == 12
    assert rows(spark.read.parquet(path)) == [(11, "a"), (12, "b")] and sorted(os.listdir(tmp_path)) == ["t"]


def test_writes_do_not_disturb_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    tables = [spark.range(0, 2000, 1, 8).selectExpr("CAST(id AS int) AS period", f"{i} AS k") for i in range(2)]
    with ThreadPoolExecutor(2) as pool:
        reports = list(pool.map(lambda t: SRC.write_table(t[1], str(tmp_path / f"t{t[0]}")).first().n_rows, enumerate(tables)))
    assert reports == [2000, 2000]
    from cadence.session import scratch_path
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_partition_overwrite_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    SRC.write_table(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "period int, k string, v double"), path, ["k"])
    rep = SRC.write_table(spark.createDataFrame([(5, "b", 9.0), (6, "c", 3.0)], "period int, k string, v double"), path, ["k"], replace="partitions")
    assert rep.first().n_rows == 3
    assert rows(spark.read.parquet(path), "period", "k", "v") == [(1, "a", 1.0), (5, "b", 9.0), (6, "c", 3.0)]
    with pytest.raises(ValueError):
        SRC.write_table(spark.range(1), path, replace="partitions")


def test_clear_scratch(spark):
    from cadence.session import clear_scratch, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path)
