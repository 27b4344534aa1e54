"""File sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.exprs import to_number, whole_number


TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, multi_line: bool = True) -> DataFrame:
    """CSV with a header row, quoted fields with embedded commas/quotes
    (RFC 4180 doubled quotes) and an optional UTF-8 BOM.  Pass an explicit
    schema for known sources; without one every column is read as text (type
    inference is T2, done in one pass afterwards).  Quoted fields may hold line
    breaks; ``multi_line=False`` lets large files without any be split between
    tasks.  With a schema a record that does not fit it fails the query."""
    r = (spark.read.option("header", header).option("quote", '"').option("escape", '"')
         .option("multiLine", multi_line).option("encoding", "UTF-8")
         .option("timestampNTZFormat", TIMESTAMP + "[.SSSSSS][.SSS]"))
    if schema is not None:
        r = r.schema(schema).option("mode", "FAILFAST")
    df = r.csv(path)
    # a BOM-prefixed first header keeps the BOM in its name on some readers
    first = df.columns[0] if df.columns else None
    if first and first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').option("timestampNTZFormat", TIMESTAMP + ".SSSSSS").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def optional_source(spark: SparkSession, path: str, required: Iterable[str],
                    schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """S3: a missing path or missing required columns give an empty result
    with the declared schema, not an error; a cell that does not fit its type
    is NULL."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        return empty
    df = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    if set(required) - set(df.columns):
        return empty
    def typed(f: T.StructField):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        if isinstance(df.schema[f.name].dataType, T.StringType) and isinstance(f.dataType, T.IntegralType):
            return whole_number(f.name).try_cast(f.dataType).alias(f.name)
        return F.col(f.name).try_cast(f.dataType).alias(f.name)
    return df.select(*[typed(f) for f in schema.fields])


def load_intervals(df: DataFrame, start: str = "start", end: str = "end",
                   severity: str = "severity") -> DataFrame:
    """Interval catalog: integer coercion of start/end/severity, rows
    without a start dropped.  Order is a matter of the output (O2)."""
    def to_int(c):
        t = df.schema[c].dataType
        return F.col(c) if isinstance(t, (T.DateType, T.IntegerType, T.LongType)) \
            else whole_number(c).try_cast("int")
    out = df.withColumns({c: to_int(c) for c in (start, end, severity) if c in df.columns})
    return out.na.drop("any", subset=[start])


def load_facts(df: DataFrame, key_candidates: Sequence[str], numeric_columns: Iterable[str],
               key: str = "key") -> DataFrame:
    """fact/history table whose key may come under either of several
    names; listed numeric columns are coerced.  A key that is no whole number
    is NULL; without a key candidate the result is empty."""
    found = next((c for c in key_candidates if c in df.columns), None)
    if found is None:
        return df.limit(0).withColumn(key, F.lit(None).cast("bigint"))
    out = df.withColumn(key, whole_number(found))
    present = [c for c in numeric_columns if c in out.columns]
    return out.withColumns({c: to_number(c) for c in present})


def _commit(spark: SparkSession, staged: str, path: str) -> None:
    """Put a written folder in the place of ``path``; what was there goes last."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, place, old = jpath(staged), jpath(path), jpath(f"{staged}-replaced")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"{path} could not be set aside; the new table is left in {staged}")
    if not fs.rename(new, place):
        fs.rename(old, place)
        raise OSError(f"{path} could not be replaced; the new table is left in {staged}")
    fs.delete(old, True)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                period: str = "period", fmt: str = "parquet", replace: str = "all") -> DataFrame:
    """Write the consolidated table, then report rows, columns and the period
    range of what is on disk (one aggregate over the written files, so the report
    cannot drift from the data).

    The table is written to a staging folder of its own beside ``path`` and takes
    its place by renaming once all tasks are done: a write that fails leaves the old
    table, and ``df`` may read it.  ``replace="partitions"`` exchanges only the
    partitions that ``df`` has rows for; Spark stages and commits those itself.  Of
    two calls at a time each writes its own table and the later commit stays."""
    spark = df.sparkSession
    if replace not in ("all", "partitions") or replace == "partitions" and not partition_by:
        raise ValueError("replace all, or partitions of a partitioned table")
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if replace == "partitions":
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
    else:
        staged = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        try:
            w.save(staged)
        except Exception:
            jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
            jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
            raise
        _commit(spark, staged, path)
    back = spark.read.format(fmt).load(path)
    return back.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.lit(len(back.columns)).cast("int").alias("n_cols"),
                    F.min(period).alias("min_period"), F.max(period).alias("max_period"))


def read_partitions(spark: SparkSession, path: str, column: str, lo, hi, fmt: str = "parquet") -> DataFrame:
    """Read a table written by ``write_table(..., partition_by=[column])`` for
    an inclusive range of the partition column; the range becomes a
    partition filter, so only the matching directories are listed and read."""
    return spark.read.format(fmt).load(path).where(F.col(column).between(lo, hi))
