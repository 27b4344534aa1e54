"""Many-series forecasting.

Fitting reduces to distributed sufficient statistics: one grouped aggregate
computes, per (entity, fit scope, time block), n, sums and cross-products of
the standardised features and the target.  A small per-entity solve (p <= a
handful of features) then runs in ``mapInPandas`` on one row per entity —
no raw observation leaves the executors.  The windows of M1-M5 do gather each
entity's series (its periods, not raw rows) in one task.
"""

from cadence.operators.forecast.pipeline import fit_predict

__all__ = ["fit_predict"]
