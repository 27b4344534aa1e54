"""Typing, cleaning and data contracts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.exprs import default_text, finite, to_number


def numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Coerce the listed columns that exist to DOUBLE; bad values -> NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(c) for c in present})


def infer_numeric(df: DataFrame, keep_text: Iterable[str] = ()) -> DataFrame:
    """All-or-nothing numeric inference.  A text column becomes DOUBLE only
    when every non-NULL value parses; columns in ``keep_text`` stay text.
    One aggregate pass over the data decides for all columns at once."""
    keep = set(keep_text)
    cand = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not cand:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & to_number(c).isNull()).alias(c)
                   for c in cand]).first()
    convert = [c for c in cand if bad[c] == 0]
    return df.withColumns({c: to_number(c) for c in convert})


def add_missing(df: DataFrame, columns: Iterable[str], dtype: str = "double") -> DataFrame:
    """Reserved metric columns are added as NULL when absent."""
    return df.withColumns({c: F.lit(None).cast(dtype) for c in columns if c not in df.columns})


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T4: drop rows whose key is NULL."""
    return df.na.drop("any", subset=list(keys))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """T5: drop rows with a NULL in any of the used columns."""
    return df.na.drop("any", subset=list(columns))


def nonfinite_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """NaN / +-inf -> NULL."""
    return df.withColumns({c: finite(c) for c in columns})


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys occurring more than once, with their count (a partial
    aggregation, so a hot key is combined map-side)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """T7 guard: raise when the key is not unique; returns ``df`` unchanged."""
    if not key_violations(df, keys).isEmpty():
        raise ValueError(f"{name}: key {list(keys)} is not unique")
    return df


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], name: str = "table") -> DataFrame:
    """Required-column contract, checked at plan time."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df


def domain_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One aggregate counting violations of every rule; output rows
    (rule, violations).  A rule is a boolean column that is true on a
    violating row."""
    names = list(rules)
    agg = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"r{i}")
                   for i, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations"))
                      for i, n in enumerate(names)])
    return agg.select(F.inline(pairs))


def default_fill(df: DataFrame, columns: Iterable[str], default: str) -> DataFrame:
    """NULL or blank text -> default label."""
    return df.withColumns({c: default_text(c, default) for c in columns})
