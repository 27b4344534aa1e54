"""Gradient boosting with the Huber loss (M9), one booster per entity and scope.

Spark gathers the rows of an (entity, scope), which are as many as the series has
periods, and ``mapInPandas`` fits ``STACK`` boosters together: each round takes
the Huber residuals (delta is a quantile of that round's errors), finds the splits
of a tree of depth two from histogram sums grouped by (booster, node, bin), and
sets each leaf to its median error plus the mean clipped deviation from it.

A booster is three flat arrays (split features, thresholds, leaf values), and
prediction is a fold over them inside the JVM, next to the features.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Booster settings (trees, learning rate, depth, min leaf, quantile of the Huber delta).
N_TREES, LEARNING_RATE, MAX_DEPTH, MIN_LEAF, HUBER_QUANTILE = 300, 0.03, 2, 2, 0.9
#: bins of a feature; exact up to so many distinct values
BINS = 256
#: gains that differ by less than this share count as tied: the first feature and bin win
TIE = 1e-9
STACK = 64

BOOSTER = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("n", T.LongType()), T.StructField("start", T.DoubleType()),
    T.StructField("split", T.ArrayType(T.IntegerType())), T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("leaf", T.ArrayType(T.DoubleType())), T.StructField("importance", T.ArrayType(T.DoubleType()))])


def bins_of(x: np.ndarray) -> np.ndarray:
    """Bin of each value: the place of its distinct value, or, beyond ``BINS`` of
    them, of its share of the distinct values."""
    values, place = np.unique(x, return_inverse=True)
    return place if len(values) <= BINS else place * BINS // len(values)


def quantile(x: np.ndarray, live: np.ndarray, q: float) -> np.ndarray:
    """Quantile of each row's live values, interpolated linearly."""
    ordered = np.sort(np.where(live, x, np.inf), axis=1)
    at = q * (live.sum(1) - 1)
    lo = np.floor(at).astype(int)
    rows = np.arange(len(x))
    low, high = ordered[rows, lo], ordered[rows, np.minimum(lo + 1, live.sum(1) - 1)]
    return low + (high - low) * (at - lo)


def best_splits(x: np.ndarray, bins: np.ndarray, r: np.ndarray, live: np.ndarray, node: np.ndarray, nodes: int):
    """For each booster and node: split feature, threshold (infinite: no split) and
    the squared error that the split takes away.  ``x`` and ``bins`` have the shape
    (boosters, rows, features), the others (boosters, rows)."""
    count, _, p = x.shape
    group = (np.arange(count)[:, None] * nodes + node)[live]
    gains = np.empty((count * nodes, p, BINS))
    for j in range(p):
        key = group * BINS + bins[..., j][live]
        n = np.cumsum(np.bincount(key, minlength=count * nodes * BINS).reshape(-1, BINS), axis=1)
        s = np.cumsum(np.bincount(key, r[live], minlength=count * nodes * BINS).reshape(-1, BINS), axis=1)
        n_right, s_right = n[:, -1:] - n, s[:, -1:] - s
        fits = (n >= MIN_LEAF) & (n_right >= MIN_LEAF)
        gap = s / np.maximum(n, 1) - s_right / np.maximum(n_right, 1)
        gains[:, j] = np.where(fits, n * n_right / np.maximum(n + n_right, 1) * gap ** 2, 0.0)
    flat = gains.reshape(count * nodes, -1)
    best = flat.max(1, keepdims=True)
    pick = np.argmax(flat >= best * (1 - TIE), axis=1)
    feature, last = (a.reshape(count, nodes) for a in np.divmod(pick, BINS))
    best = best.reshape(count, nodes)
    # the threshold lies halfway between the node's own values on either side
    rows, chosen = np.arange(count)[:, None], np.take_along_axis(feature, node, axis=1)
    own, at = np.take_along_axis(x, chosen[..., None], 2)[..., 0], np.take_along_axis(bins, chosen[..., None], 2)[..., 0]
    left = at <= np.take_along_axis(last, node, axis=1)
    low, high = np.full((count, nodes), -np.inf), np.full((count, nodes), np.inf)
    np.maximum.at(low, (rows, node), np.where(live & left, own, -np.inf))
    np.minimum.at(high, (rows, node), np.where(live & ~left, own, np.inf))
    split = best > 1e-12
    threshold = np.where(split, np.where(split, low, 0) / 2 + np.where(split, high, 0) / 2, np.inf)
    return np.where(split, feature, 0), threshold, np.where(split, best, 0.0)


def leaf_values(errors: np.ndarray, leaf: np.ndarray, live: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """Per booster and leaf, the median error and the mean deviation from it, cut
    off at ``delta``; 0 for an empty leaf."""
    leaves = 2 ** MAX_DEPTH
    out = np.zeros((len(errors), leaves))
    for k in range(leaves):
        inside = live & (leaf == k)
        some = inside.any(1)
        if some.any():
            e, m = errors[some], inside[some]
            middle = quantile(e, m, 0.5)
            off = e - middle[:, None]
            cut = np.sign(off) * np.minimum(np.abs(off), delta[some, None])
            out[some, k] = middle + np.where(m, cut, 0).sum(1) / m.sum(1)
    return out


def boost(x: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """Boosters of some stacked series: ``x`` (boosters, rows, features), ``y`` and
    ``live`` (boosters, rows); rows that are not live are padding."""
    count, _, p = x.shape
    bins = np.zeros(x.shape, int)
    for i in range(count):
        for j in range(p):
            bins[i, live[i], j] = bins_of(x[i, live[i], j])
    start = quantile(y, live, 0.5)
    raw = np.repeat(start[:, None], x.shape[1], axis=1)
    splits, thresholds, leaves, gain = [], [], [], np.zeros((count, p))
    rows = np.arange(count)[:, None]
    for _ in range(N_TREES):
        errors = np.where(live, y - raw, 0.0)
        delta = quantile(np.abs(errors), live, HUBER_QUANTILE)
        residual = np.where(np.abs(errors) <= delta[:, None], errors, delta[:, None] * np.sign(errors))
        node, found = np.zeros(y.shape, int), []
        for depth in range(MAX_DEPTH):
            feature, threshold, g = best_splits(x, bins, residual, live, node, 2 ** depth)
            np.add.at(gain, (rows, feature), g)
            own = np.take_along_axis(x, np.take_along_axis(feature, node, axis=1)[..., None], 2)[..., 0]
            node = 2 * node + (own > np.take_along_axis(threshold, node, axis=1))
            found.append((feature, threshold))
        values = leaf_values(errors, node, live, delta)
        raw = raw + LEARNING_RATE * np.take_along_axis(values, node, axis=1)
        splits.append(np.concatenate([f for f, _ in found], axis=1))
        thresholds.append(np.concatenate([t for _, t in found], axis=1))
        leaves.append(values)
    total = gain.sum(1, keepdims=True)
    return {"start": start, "split": np.concatenate(splits, axis=1), "threshold": np.concatenate(thresholds, axis=1),
            "leaf": np.concatenate(leaves, axis=1), "importance": np.where(total > 0, gain / np.where(total > 0, total, 1), 0.0), "fitted": raw}


def fit(scoped: DataFrame, keys: Sequence[str], feats: Sequence[str], period: str, y: str = "target_model") -> DataFrame:
    """One booster per (keys, ``scope``); the rows of a booster are one series."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    point = F.struct(F.col(period).alias("t"), F.array(*feats).alias("x"), F.col(y).alias("y"))
    series = scoped.groupBy(*keys, "scope").agg(F.sort_array(F.collect_list(point)).alias("_s"))
    series = series.select(*keys, "scope", F.flatten("_s.x").alias("x"), F.col("_s.y").alias("y"))
    schema = T.StructType([*(scoped.schema[k] for k in keys), *BOOSTER.fields])
    p = len(feats)

    def solve(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), STACK):
                some = pdf.iloc[lo:lo + STACK]
                n = np.array([len(v) for v in some["y"]])
                live = np.arange(n.max()) < n[:, None]
                x, target = np.zeros((*live.shape, p)), np.zeros(live.shape)
                x[live], target[live] = np.concatenate(list(some["x"])).reshape(-1, p), np.concatenate(list(some["y"]))
                found = boost(x, target, live)
                out = some[[*keys, "scope"]].assign(n=n.astype("int64"), start=found["start"])
                for c in ("split", "threshold", "leaf", "importance"):
                    out[c] = list(found[c])
                yield pd.DataFrame(out[schema.fieldNames()])

    return series.mapInPandas(solve, schema)


def predict_expr(feats: Sequence[str]) -> Column:
    """The booster's value at a row's features: the start, and each tree's leaf."""
    x, splits = F.array(*[F.col(f).cast("double") for f in feats]), 2 ** MAX_DEPTH - 1

    def side(at: Column) -> Column:
        return (F.get(x, F.get("split", at)) > F.get("threshold", at)).cast("int")

    def leaf(tree: Column) -> Column:
        # the node at depth d, counted within its depth, is preceded by 2^d - 1 others
        node = F.lit(0)
        for depth in range(MAX_DEPTH):
            node = node * 2 + side(tree * splits + (2 ** depth - 1) + node)
        return F.get("leaf", tree * 2 ** MAX_DEPTH + node)

    trees = F.sequence(F.lit(0), F.lit(N_TREES - 1))
    return F.aggregate(trees, F.col("start"), lambda total, tree: total + LEARNING_RATE * leaf(tree))


def details() -> dict[str, Column]:
    """What the metrics say of the model."""
    return {"n_trees": F.lit(N_TREES), "max_depth": F.lit(MAX_DEPTH), "learning_rate": F.lit(LEARNING_RATE),
            "min_leaf": F.lit(MIN_LEAF), "loss": F.lit("huber")}
