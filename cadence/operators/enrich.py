"""Enrichment joins and derived money columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.exprs import combine_text, finite, safe_div


def validated_left_join(base: DataFrame, enrichment: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join that is one-to-one by contract (T7 on both sides).

    Both sides carry the running number of their row within its key, over the
    partitioning and order the join needs anyway, and a second row fails the
    query when it runs: no job beside the join.  Rows with a NULL key match
    nothing and repeat freely: those of the base are set aside before the check,
    stay in the tasks that read them and are united with the result; those of the
    enrichment go."""
    on = list(on)
    full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])

    def once(df: DataFrame, side: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(*on).orderBy(*on))
        twice = F.raise_error(F.concat(F.lit(f"duplicate key in {side}: "), F.to_json(F.struct(*on))))
        return df.where(full).withColumn("_k", k).where(F.when(F.col("_k") > 1, twice.cast("boolean")).otherwise(True)).drop("_k")

    matched = once(base, "base").join(once(enrichment, "enrichment"), on, "left")
    added = [f for f in enrichment.schema.fields if f.name not in on]
    aside = base.where(~full).select(*on, *[c for c in base.columns if c not in on], *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return matched.union(aside)


def precedence(df: DataFrame, overrides: Mapping[str, str], keep_original: bool = True) -> DataFrame:
    """``target = coalesce(enriched, target)``; the previous value is kept
    as ``<target>_original`` for audit."""
    out = df
    for target, enriched in overrides.items():
        if enriched not in out.columns:
            continue
        base = F.col(target) if target in out.columns else F.lit(None)
        if keep_original:
            out = out.withColumn(f"{target}_original", base)
        out = out.withColumn(target, F.coalesce(F.col(enriched), base))
    return out


def merge_text(df: DataFrame, target: str, other: str, keep_original: bool = True) -> DataFrame:
    """Merge two text columns without blanks or duplicates (' | ')."""
    if keep_original:
        df = df.withColumn(f"{target}_original", F.col(target))
    return df.withColumn(target, combine_text(target, other))


def convert_currency(df: DataFrame, pairs: Mapping[str, str], rate: str) -> DataFrame:
    """``out = amount * rate`` for each (amount -> out) pair present."""
    return df.withColumns({out: F.col(src) * F.col(rate)
                           for src, out in pairs.items() if src in df.columns})


def deflate(df: DataFrame, pairs: Mapping[str, str], deflator: str) -> DataFrame:
    """real = nominal / (deflator / 100); a zero or NULL deflator gives
    NULL.  An existing (audited) real column wins; gaps are filled."""
    cols = {}
    for nominal, real in pairs.items():
        if nominal not in df.columns:
            continue
        computed = finite(safe_div(F.col(nominal), F.col(deflator) / 100))
        cols[real] = F.coalesce(F.col(real), computed) if real in df.columns else computed
    return df.withColumns(cols)


def add_total(df: DataFrame, out: str, parts: Sequence[str]) -> DataFrame:
    """Additive total with NULL propagation (any NULL part -> NULL)."""
    if not all(p in df.columns for p in parts):
        return df
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return df.withColumn(out, total)


def per_capita(df: DataFrame, out: str, amount: str, population: str) -> DataFrame:
    """Amount / population (NULL when population is 0 or NULL)."""
    return df.withColumn(out, safe_div(F.col(amount), F.col(population)))
