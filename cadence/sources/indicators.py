"""Wide indicator tables: one string column per year."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.exprs import to_number

# The identifier columns of a wide indicator table and their
# snake-case names; missing cells are written as '..'.
ID_COLUMNS = {"Series Name": "series_name", "Series Code": "series_code",
              "Country Name": "country_name", "Country Code": "country_code"}
MISSING = ".."
YEAR = re.compile(r"\d{4}")


def year_label(year: int) -> str:
    return f"{year} [YR{year}]"


def melt_indicators(raw: DataFrame) -> DataFrame:
    """Every column whose name contains four digits is a value column;
    unpivot, year by regex, '..' and unparsable text -> NULL, rows with NULL
    year or value dropped, identifiers renamed to snake case.  A table
    without the identifier columns yields an empty result (S3)."""
    ids = list(ID_COLUMNS)
    spark = raw.sparkSession
    schema = ("series_name string, series_code string, country_name string, "
              "country_code string, year int, value double")
    if set(ids) - set(raw.columns):
        return spark.createDataFrame([], schema)
    year_cols = [c for c in raw.columns if YEAR.search(c)]
    if not year_cols:
        return spark.createDataFrame([], schema)
    long = raw.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in year_cols]) \
        .unpivot(ids, year_cols, "year_raw", "value_raw")
    out = long.select(
        *[F.col(f"`{k}`").alias(v) for k, v in ID_COLUMNS.items()],
        F.nullif(F.regexp_extract("year_raw", r"(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        to_number(F.when(F.col("value_raw") != MISSING, F.col("value_raw"))).alias("value"))
    return out.na.drop("any", subset=["year", "value"])


def pivot_indicators(long: DataFrame, ids: Sequence[str], year: str, value: str,
                     years: Sequence[int]) -> DataFrame:
    """Inverse of S2 (used to build wide fixtures from panels): one text
    column per year label, missing cells as '..'.  The year list is explicit,
    so the pivot is a single aggregation."""
    labels = {y: year_label(y) for y in years}
    d = long.select(*ids, F.col(year).cast("int").alias("_y"),
                    F.coalesce(F.col(value).cast("string"), F.lit(MISSING)).alias("_v"))
    wide = d.groupBy(*ids).pivot("_y", list(years)).agg(F.first("_v"))
    return wide.select(*ids, *[F.coalesce(F.col(str(y)), F.lit(MISSING)).alias(labels[y])
                               for y in years])
