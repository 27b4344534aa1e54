"""Relationships between series: correlation matrices (A8, A9) and
cross-correlation by lag (A10).

Each entity's series is a window partition of bounded length (its periods),
and every pair/lag statistic is an expression of ONE grouped aggregate, so the
data is scanned and shuffled once regardless of the number of pairs or lags.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.exprs import guarded_corr, pair_count
from cadence.operators.transforms import pct_change_expr
from cadence.panel import series_window


def _changes(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str]) -> DataFrame:
    w = series_window(keys, period)
    return df.select(*keys, period, *[pct_change_expr(m, w).alias(m) for m in metrics])


def _emit_pairs(g: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    structs = []
    for a, b in combinations_with_replacement(range(len(metrics)), 2):
        ma, mb = metrics[a], metrics[b]
        r, n = F.col(f"r_{a}_{b}"), F.col(f"n_{a}_{b}")
        structs.append(F.struct(F.lit(ma).alias("metric_x"), F.lit(mb).alias("metric_y"),
                                r.alias("r"), n.alias("n")))
        if a != b:
            structs.append(F.struct(F.lit(mb).alias("metric_x"), F.lit(ma).alias("metric_y"),
                                    r.alias("r"), n.alias("n")))
    return g.select(*keys, F.inline(F.array(*structs)))


def correlation_matrix(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str],
                       use_changes: bool = False, min_n: int = 2) -> DataFrame:
    """Pearson matrix per entity on levels or gap-preserving % changes,
    pairwise complete.  Output (keys, metric_x, metric_y, r, n)."""
    d = _changes(df, keys, period, metrics) if use_changes else df.select(*keys, period, *metrics)
    aggs = []
    for a, b in combinations_with_replacement(range(len(metrics)), 2):
        x, y = F.col(metrics[a]), F.col(metrics[b])
        n = pair_count(x, y)
        aggs += [F.when(n >= min_n, guarded_corr(x, y)).alias(f"r_{a}_{b}"), n.alias(f"n_{a}_{b}")]
    return _emit_pairs(d.groupBy(*keys).agg(*aggs), keys, metrics)


def spearman_matrix(df: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str],
                    use_changes: bool = False, min_n: int = 2) -> DataFrame:
    """Spearman = Pearson on average ranks computed on each pair's
    complete rows.

    The ranks of a pair depend on which rows it is complete in.  Pairs of an
    entity that are complete in the same rows share them: a row is copied once
    per distinct such set of rows (once in all, if no value is missing), each
    metric is ranked once in it, and all its pairs are expressions of one
    aggregate.  Sets of rows are told apart by the NULL masks in them, of which
    an entity has few.  A metric with itself is not ranked: r is 1 unless it is
    constant."""
    d = _changes(df, keys, period, metrics) if use_changes else df.select(*keys, period, *metrics)
    p = len(metrics)
    if p > 62:
        raise ValueError("up to 62 metrics at a time")
    pairs = list(combinations(range(p), 2))
    bits = {pair: (1 << pair[0]) | (1 << pair[1]) for pair in pairs}
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(m).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, m in enumerate(metrics)])
    d = d.withColumn("_mask", mask)
    own = []
    for i, m in enumerate(metrics):
        n = F.count(m)
        own.append(F.struct(F.lit(m).alias("metric_x"), F.lit(m).alias("metric_y"),
                            F.when((n >= min_n) & (F.min(m) != F.max(m)), F.lit(1.0)).alias("r"), n.alias("n")))

    def rows_of(pair) -> Column:
        """The masks of the rows that a pair is complete in; they name the rows."""
        both = F.lit(bits[pair]).cast("long")
        return F.array_sort(F.filter("_masks", lambda x: x.bitwiseAND(both) == both))

    entity = d.groupBy(*keys).agg(F.collect_set("_mask").alias("_masks"), F.array(*own).alias("_own"))
    entity = entity.withColumn("_pairs", F.array(*map(rows_of, pairs)) if pairs else F.lit(None).cast("array<array<bigint>>"))
    sets = entity.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.explode(F.array_distinct("_pairs")).alias("_set"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    copied = d.join(sets, same).where(F.array_contains("_set", F.col("_mask"))).drop(*[f"_k_{k}" for k in keys])
    part = [*keys, "_set"]

    def avg_rank(c: str) -> Column:
        return (F.rank().over(Window.partitionBy(*part).orderBy(c))
                + (F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1) / 2.0)

    ranked = copied.select(*part, *[avg_rank(m).alias(f"_r{i}") for i, m in enumerate(metrics)])
    # a pair is read off the set of rows that is its own
    shared = ranked.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), *[guarded_corr(f"_r{a}", f"_r{b}").alias(f"_r{a}_{b}") for a, b in pairs])
    found = entity.select(*keys, "_own", F.posexplode_outer("_pairs").alias("_i", "_set"))
    shared = shared.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_set").alias("_s"), "_n",
                           F.array(*[F.col(f"_r{a}_{b}") for a, b in pairs]).cast("array<double>").alias("_r"))
    found = found.join(shared, [*same, F.col("_set") == F.col("_s")], "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    r = F.when(n >= min_n, F.get("_r", F.col("_i")))
    names = lambda at: F.get(F.array(*[F.lit(metrics[x[at]]) for x in pairs]).cast("array<string>"), F.col("_i"))
    both = F.array(*[F.struct(names(x).alias("metric_x"), names(y).alias("metric_y"), r.alias("r"), n.alias("n")) for x, y in ((0, 1), (1, 0))])
    # the first pair's row (or the only row, without pairs) also brings the metrics themselves
    nothing = F.array().cast("array<struct<metric_x:string,metric_y:string,r:double,n:bigint>>")
    own = F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_own")).otherwise(nothing)
    return found.select(*keys, F.inline(F.concat(own, F.when(F.col("_i").isNotNull(), both).otherwise(nothing))))


def cross_correlation(df: DataFrame, keys: Sequence[str], period: str, target: str, driver: str,
                      lags: Sequence[int] = range(-5, 6), use_changes: bool = False,
                      min_n: int = 4) -> DataFrame:
    """A10: corr(target_t, driver_{t-lag}) for each lag (negative = driver
    leads), with the pair count; r is NULL when n < ``min_n``."""
    w = series_window(keys, period)
    t = pct_change_expr(target, w) if use_changes else F.col(target)
    dr = pct_change_expr(driver, w) if use_changes else F.col(driver)
    d = df.select(*keys, period, t.alias("_t"), dr.alias("_d"))
    shifted = {k: (F.lag("_d", k).over(w) if k >= 0 else F.lead("_d", -k).over(w)) for k in lags}
    d = d.select(*keys, "_t", *[s.alias(f"_d{i}") for i, s in enumerate(shifted.values())])
    aggs = []
    for i in range(len(shifted)):
        n = pair_count("_t", f"_d{i}")
        aggs += [F.when(n >= min_n, guarded_corr("_t", f"_d{i}")).alias(f"r{i}"), n.alias(f"n{i}")]
    g = d.groupBy(*keys).agg(*aggs)
    rows = [F.struct(F.lit(k).alias("lag"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, k in enumerate(shifted)]
    return g.select(*keys, F.inline(F.array(*rows)))
