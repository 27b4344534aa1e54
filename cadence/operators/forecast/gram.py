"""Block sufficient statistics and the per-entity fit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.forecast import solvers

MODELS = ("ols", "elastic_net", "bayesian_ridge")
#: fits solved together: with the elastic net's 840 grid points about 200 000 small problems
STACK = 256


def block_stats(z: DataFrame, keys: Sequence[str], features: Sequence[str], y: str = "target_model",
                standardised: bool = True) -> DataFrame:
    """One grouped aggregate: per (keys, scope, block) the count, sums and
    cross-products of the (standardised) features and the target, then the
    <= 6 blocks of an (entity, scope) are gathered into one row (a bounded
    list) carrying the scaling parameters."""
    zc = [F.col(f"z_{f}" if standardised else f) for f in features]
    yc = F.col(y)
    p = len(features)
    aggs = [F.count(F.lit(1)).cast("double").alias("n"),
            F.array(*[F.sum(c) for c in zc]).alias("sz"),
            F.sum(yc).alias("sy"),
            F.array(*[F.sum(zc[i] * zc[j]) for i in range(p) for j in range(p)]).alias("szz"),
            F.array(*[F.sum(c * yc) for c in zc]).alias("szy"),
            F.sum(yc * yc).alias("syy"),
            F.first("k_folds").alias("k_folds")]
    if standardised:
        aggs += [F.array(*[F.first(f"mu_{f}") for f in features]).alias("mu"),
                 F.array(*[F.first(f"sd_{f}") for f in features]).alias("sd")]
    else:
        aggs += [F.array(*[F.lit(0.0) for _ in features]).alias("mu"),
                 F.array(*[F.lit(1.0) for _ in features]).alias("sd")]
    b = z.groupBy(*keys, "scope", "block").agg(*aggs)
    blk = F.struct("block", "n", "sz", "sy", "szz", "szy", "syy")
    return b.groupBy(*keys, "scope").agg(F.collect_list(blk).alias("blocks"),
                                         F.first("k_folds").alias("k_folds"),
                                         F.first("mu").alias("mu"), F.first("sd").alias("sd"))


def coef_schema(key_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*key_fields,
                         T.StructField("scope", T.StringType()),
                         T.StructField("n", T.LongType()),
                         T.StructField("intercept", T.DoubleType()),
                         T.StructField("coef", T.ArrayType(T.DoubleType())),
                         T.StructField("mu", T.ArrayType(T.DoubleType())),
                         T.StructField("sd", T.ArrayType(T.DoubleType())),
                         T.StructField("alpha", T.DoubleType()),
                         T.StructField("l1_ratio", T.DoubleType()),
                         T.StructField("n_zero_coef", T.IntegerType()),
                         T.StructField("converged", T.BooleanType()),
                         T.StructField("noise_precision", T.DoubleType()),
                         T.StructField("weight_precision", T.DoubleType()),
                         T.StructField("posterior_std", T.ArrayType(T.DoubleType()))])


def _as_dict(x):
    return x if isinstance(x, dict) else x.asDict() if hasattr(x, "asDict") else dict(x)


def _ship_by_value() -> None:
    """Serialise the solver code with the task (cloudpickle by value), so
    executors need numpy/pandas only — not this package on their path."""
    import sys

    from pyspark import cloudpickle
    for mod in (solvers, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(mod)


def fit(stats: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """Solve every (entity, scope) in ``mapInPandas``: one input row per
    entity and scope, and ``STACK`` of them are solved together."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}")
    _ship_by_value()
    schema = coef_schema([stats.schema[k] for k in keys])
    names = schema.fieldNames()

    def solve(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), STACK):
                yield fit_stack(pdf.iloc[lo:lo + STACK], keys, names, model)

    return stats.mapInPandas(solve, schema)


def fit_stack(pdf: pd.DataFrame, keys: Sequence[str], names: Sequence[str], model: str) -> pd.DataFrame:
    """The coefficient rows of some (entity, scope) rows, solved as one stack."""
    blocks = solvers.Stats.of_blocks([[_as_dict(b) for b in one] for one in pdf["blocks"]])
    total = blocks.over(slice(None))
    if model == "elastic_net":
        b, w, extra = solvers.elastic_net(blocks, pdf["k_folds"].to_numpy())
    else:
        b, w, extra = (solvers.ols if model == "ols" else solvers.bayesian_ridge)(total)
    extra = {name: list(x) if x.ndim > 1 else x for name, x in extra.items()}
    out = pdf[[*keys, "scope", "mu", "sd"]].assign(n=total.n.astype("int64"), intercept=b, coef=list(w), **extra)
    rest = [c for c in names if c not in out.columns]
    return out.assign(**{c: np.full(len(out), None, object) for c in rest})[list(names)]


def unscaled(coefs: DataFrame) -> DataFrame:
    """Coefficients and intercept of the raw features (scale 1, mean 0)."""
    raw = F.zip_with("coef", "sd", lambda w, s: w / s)
    shift = F.aggregate(F.zip_with(raw, "mu", lambda w, m: w * m), F.lit(0.0), lambda a, x: a + x)
    return coefs.withColumns({"intercept": F.col("intercept") - shift, "coef": raw,
                              "mu": F.transform("mu", lambda _: F.lit(0.0)),
                              "sd": F.transform("sd", lambda _: F.lit(1.0))})


def predict_expr(features: Sequence[str]):
    """yhat = intercept + sum coef_i * (x_i - mu_i) / sd_i (coefficients live
    on the standardised scale of the scope they were fitted on)."""
    e = F.col("intercept")
    for i, f in enumerate(features):
        e = e + F.col("coef")[i] * (F.col(f) - F.col("mu")[i]) / F.col("sd")[i]
    return e
