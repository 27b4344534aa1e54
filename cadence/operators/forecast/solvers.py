"""Solvers on sufficient statistics (numpy, small p), many fits at once.

All arrays have a leading axis of fits, one per (entity, scope); blocks have a
second one.  Iterative solvers drop a fit from the work once it has converged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np

# The elastic-net search grid (l1 ratios and log-spaced alphas).
L1_RATIOS = np.array([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95])
ALPHAS = np.sort(np.logspace(-5, 3, 120))[::-1]
EN_MAX_ITER = 100_000
EN_TOL = 1e-10
#: grid points whose errors differ by less than this share count as tied
EN_TIE = 1e-9
# Bayesian ridge hyper-priors and iteration limits.
BR_ALPHA_1 = BR_ALPHA_2 = BR_LAMBDA_1 = BR_LAMBDA_2 = 1e-6
BR_MAX_ITER, BR_TOL = 300, 1e-3


@dataclass
class Stats:
    """Count, sums and cross-products; additive over rows and blocks."""

    n: np.ndarray
    sz: np.ndarray
    sy: np.ndarray
    szz: np.ndarray
    szy: np.ndarray
    syy: np.ndarray

    @classmethod
    def of_blocks(cls, blocks: Sequence[Sequence[dict]]) -> Stats:
        """From each fit's blocks; a block that a fit lacks is empty."""
        fit = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        flat = [b for one in blocks for b in one]
        at = np.array([b["block"] for b in flat], int)
        p = len(flat[0]["sz"])
        shapes = {"sz": (p,), "szy": (p,), "szz": (p, p)}

        def gather(name: str) -> np.ndarray:
            out = np.zeros((len(blocks), at.max() + 1, *shapes.get(name, ())))
            out[fit, at] = np.array([b[name] for b in flat], float).reshape(len(flat), *shapes.get(name, ()))
            return out
        return cls(**{f.name: gather(f.name) for f in fields(cls)})

    def over(self, which: slice) -> Stats:
        """The sum of some of the blocks."""
        return Stats(**{f.name: getattr(self, f.name)[:, which].sum(1) for f in fields(self)})

    def block(self, i: int) -> Stats:
        return Stats(**{f.name: getattr(self, f.name)[:, i] for f in fields(self)})

    def take(self, rows: np.ndarray) -> Stats:
        return Stats(**{f.name: getattr(self, f.name)[rows] for f in fields(self)})

    @property
    def zbar(self) -> np.ndarray:
        return self.sz / self.n[..., None]

    @property
    def ybar(self) -> np.ndarray:
        return self.sy / self.n

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centred Gram matrix, centred cross-products and centred y'y."""
        zb, yb, n = self.zbar, self.ybar, self.n
        return (self.szz - n[..., None, None] * zb[..., :, None] * zb[..., None, :],
                self.szy - (n * yb)[..., None] * zb, self.syy - n * yb * yb)

    def intercept(self, w: np.ndarray) -> np.ndarray:
        return self.ybar - (self.zbar * w).sum(-1)

    def sse(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """sum (y - b - z'w)^2 from the statistics alone, for weights ``w`` of
        shape (fits, ..., p) and intercepts of shape (fits, ...)."""
        e = lambda x: x.reshape(x.shape[0], *(1,) * (b.ndim - 1))
        wzy, wz = np.einsum("f...i,fi->f...", w, self.szy), np.einsum("f...i,fi->f...", w, self.sz)
        wzzw = np.einsum("f...i,fij,f...j->f...", w, self.szz, w)
        return e(self.syy) - 2 * b * e(self.sy) - 2 * wzy + e(self.n) * b * b + 2 * b * wz + wzzw


def ols(s: Stats) -> tuple[np.ndarray, np.ndarray, dict]:
    """M6: least squares with intercept (minimum-norm when rank deficient)."""
    g, c, _ = s.centred()
    w = (np.linalg.pinv(g, hermitian=True) @ c[..., None])[..., 0]
    return s.intercept(w), w, {"converged": np.ones(len(w), bool)}


def bayesian_ridge(s: Stats) -> tuple[np.ndarray, np.ndarray, dict]:
    """M8: evidence maximisation (MacKay 1992) for the noise precision alpha
    and weight precision lambda on the centred Gram matrix; returns the
    posterior mean and the posterior std of each coefficient."""
    g, c, yy = s.centred()
    ev, vecs = np.linalg.eigh(g)
    ev = np.clip(ev, 0, None)
    proj = np.einsum("fij,fi->fj", vecs, c)
    alpha = 1.0 / (yy / s.n + np.finfo(np.float64).eps)
    lam = np.ones_like(alpha)

    def mean(f) -> np.ndarray:
        return np.einsum("fij,fj->fi", vecs[f], proj[f] / (ev[f] + (lam[f] / alpha[f])[:, None]))

    w, met, live = np.zeros_like(c), np.zeros(len(c), bool), np.arange(len(c))
    for it in range(BR_MAX_ITER):
        new = mean(live)
        rss = np.maximum(yy[live] - 2 * (new * c[live]).sum(1) + np.einsum("fi,fij,fj->f", new, g[live], new), 0)
        scaled = alpha[live, None] * ev[live]
        gamma = (scaled / (lam[live, None] + scaled)).sum(1)
        lam[live] = (gamma + 2 * BR_LAMBDA_1) / ((new ** 2).sum(1) + 2 * BR_LAMBDA_2)
        alpha[live] = (s.n[live] - gamma + 2 * BR_ALPHA_1) / (rss + 2 * BR_ALPHA_2)
        met[live] = (np.abs(w[live] - new).sum(1) < BR_TOL) & (it != 0)
        w[live] = new
        live = live[~met[live]]
        if not live.size:
            break
    every = np.arange(len(c))
    w = mean(every)
    spread = (vecs ** 2 / (ev + (lam / alpha)[:, None])[:, None, :]).sum(2) / alpha[:, None]
    return s.intercept(w), w, {"noise_precision": alpha, "weight_precision": lam, "posterior_std": np.sqrt(spread), "converged": met}


def coordinate_descent(g: np.ndarray, c: np.ndarray, n: np.ndarray, alphas: np.ndarray, ratios: np.ndarray,
                       scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate descent with covariance updates for every fit and grid point.
    Objective (1/2n)||y - Xw||^2 + a*r*|w|_1 + a*(1-r)/2*|w|^2 on centred data
    (Friedman, Hastie & Tibshirani 2010).  ``alphas`` and ``ratios`` have the
    shape (fits, points); returns w of shape (fits, points, p) and whether each
    met the tolerance, in units of ``scale``.  Points that did leave the work."""
    shape, p = alphas.shape, c.shape[1]
    fit = np.repeat(np.arange(shape[0]), shape[1])
    l1, l2 = ((n[:, None] * x).ravel() for x in (alphas * ratios, alphas * (1 - ratios)))
    out, met = np.zeros((fit.size, p)), np.zeros(fit.size, bool)
    live, w, gl, cl = np.arange(fit.size), np.zeros((fit.size, p)), g[fit], c[fit]
    tol = EN_TOL * np.maximum(1.0, scale)[fit]
    for _ in range(EN_MAX_ITER):
        delta = np.zeros(live.size)
        for j in range(p):
            old, diag = w[:, j], gl[:, j, j]
            rho = cl[:, j] - (w * gl[:, :, j]).sum(1) + diag * old
            new = np.where(diag > 0, np.sign(rho) * np.maximum(np.abs(rho) - l1, 0) / np.where(diag > 0, diag + l2, 1), 0.0)
            delta = np.maximum(delta, np.abs(new - old))
            w[:, j] = new
        done = delta <= tol
        out[live], met[live] = w, done
        if done.all():
            break
        if 4 * done.sum() >= done.size:
            live, w, gl, cl, l1, l2, tol = (x[~done] for x in (live, w, gl, cl, l1, l2, tol))
    return out.reshape(*shape, p), met.reshape(shape)


def elastic_net(blocks: Stats, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """M7: choose (alpha, l1 ratio) by expanding-window time folds (fold i
    trains on blocks < i, tests on block i) from block statistics alone, then
    refit on all rows.  Of grid points tied for the least error, the first counts:
    by ratio, then the larger alpha."""
    count = len(blocks.n)
    ratios, alphas = (x.ravel() for x in np.meshgrid(L1_RATIOS, ALPHAS, indexing="ij"))
    total = blocks.over(slice(None))
    scale = np.sqrt(np.maximum(total.syy / total.n, 0))
    error, folds, met = np.zeros((count, alphas.size)), np.zeros(count), np.ones(count, bool)
    for i in range(1, blocks.n.shape[1]):
        train, test = blocks.over(slice(0, i)), blocks.block(i)
        rows = np.flatnonzero((k >= i) & (test.n > 0) & (train.n > 0))
        if not rows.size:
            continue
        train, test = train.take(rows), test.take(rows)
        g, c, _ = train.centred()
        grid = [np.broadcast_to(x, (rows.size, x.size)) for x in (alphas, ratios)]
        w, ok = coordinate_descent(g, c, train.n, *grid, scale[rows])
        b = train.ybar[:, None] - np.einsum("fgi,fi->fg", w, train.zbar)
        error[rows] += test.sse(b, w) / test.n[:, None]
        folds[rows] += 1
        met[rows] &= ok.all(1)
    error /= np.maximum(folds, 1)[:, None]
    least = error.min(1, keepdims=True)
    pick = np.argmax(error <= least + EN_TIE * np.abs(least), axis=1)
    g, c, _ = total.centred()
    w, ok = coordinate_descent(g, c, total.n, alphas[pick][:, None], ratios[pick][:, None], scale)
    w = w[:, 0]
    return total.intercept(w), w, {"alpha": alphas[pick], "l1_ratio": ratios[pick], "n_zero_coef": np.isclose(w, 0.0).sum(1).astype("int32"),
                                   "converged": met & ok[:, 0]}
