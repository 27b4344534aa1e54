"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the driver tables at ``sf_dir`` (or data Spark derives from
them) in full; parameters are feature parameters (base period, lag, horizon),
never row caps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def rnd(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    """Round floating results of order-dependent aggregations so that both
    engines agree (adding 0.0 normalises -0.0)."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def sig(df: DataFrame, cols, digits: int = 7) -> DataFrame:
    """Round to ``digits`` significant digits (for compounded levels whose
    magnitude varies by series)."""
    def one(c):
        # scale by an exact positive power of ten (exact in every engine for
        # exponents <= 22) and pick multiply/divide by the sign of the exponent
        x = F.col(c)
        e = F.floor(F.log10(F.abs(x)))
        p = F.pow(F.lit(10.0), F.abs(e))
        scaled = F.when(e >= 0, x / p).otherwise(x * p)
        r = F.round(scaled, digits - 1)
        back = F.when(e >= 0, r * p).otherwise(r / p)
        return F.when(x == 0, F.lit(0.0)).otherwise(back) + F.lit(0.0)
    return df.withColumns({c: one(c) for c in cols})


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from cadence.plans import (q_forecast, q_joins, q_quality, q_series,  # noqa: F401
                               q_stream, q_summary)
    return REGISTRY
