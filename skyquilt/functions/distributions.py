"""Normal and gamma distribution functions in numpy, and as Arrow-batched UDFs for the transformers."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()
#: Shapes from which on the gamma distribution is integrated: series and fraction need terms by the root of the shape.
LARGE = 500
_NODES, _WEIGHTS = (v / 2 for v in np.polynomial.legendre.leggauss(64))


def norm_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([math.erfc(-v / math.sqrt(2)) / 2 if v == v else math.nan for v in x.ravel()]).reshape(x.shape)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    one = lambda v: _NORMAL.inv_cdf(v) if 0 < v < 1 else (math.nan if v != v or v < 0 or v > 1 else math.copysign(math.inf, v - 0.5))
    return np.array([one(v) for v in p.ravel()]).reshape(p.shape)


def _gamma_cdf_large(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma for z > 0 and a >= LARGE: the tail beyond z by Gauss-Legendre quadrature, over 11 deviations
    or until the density has fallen by e^-45. Logarithms are of z / a, so large ones don't cancel."""
    root, mu, side = np.sqrt(a), (z - a) / a, np.where(z < a, -1.0, 1.0)
    phi = lambda m: m - np.log1p(m)
    with np.errstate(all="ignore"):
        width = np.minimum(11.0, 45 * (1 + mu) / (root * np.abs(mu))) / root
        at = mu[:, None] + (side * width)[:, None] * (_NODES + 0.5)
        sums = (np.exp(-a[:, None] * (phi(at) - phi(mu)[:, None])) / (1 + at)) @ _WEIGHTS
        peak = np.exp(-a * phi(mu) - 1 / (12 * a) + 1 / (360 * a**3)) * np.sqrt(a / (2 * math.pi))
        tail = np.where(peak > 0, peak * width * sums, 0)
    return np.where(side < 0, tail, 1 - tail)


def gamma_cdf(x: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma of x / beta; shapes are broadcast. alpha or beta <= 0 gives NaN."""
    x, alpha, beta = np.broadcast_arrays(np.asarray(x, float), np.asarray(alpha, float), np.asarray(beta, float))
    out = np.full(x.shape, np.nan)
    valid = (alpha > 0) & (beta > 0) & ~np.isnan(x)
    z, a = np.where(valid, np.maximum(x, 0) / np.where(beta > 0, beta, 1), 0), np.where(valid, alpha, 1)
    out[valid] = 0
    log_gamma = np.array([math.lgamma(v) for v in a.ravel()]).reshape(a.shape)
    positive = valid & (z > 0)
    with np.errstate(all="ignore"):
        front = np.exp(-z + a * np.log(np.where(positive, z, 1)) - log_gamma)
        large = positive & (a >= LARGE)
        if large.any():
            out[large] = _gamma_cdf_large(z[large], a[large])
        series = positive & ~large & (z < a + 1)
        if series.any():
            zs, s = z[series], a[series]
            term = total = 1 / s
            for n in range(1, 1000):
                term = term * zs / (s + n)
                total = total + term
                if np.all(np.abs(term) < 1e-16 * np.abs(total)):
                    break
            out[series] = total * front[series]
        rest = positive & ~large & ~series
        if rest.any():  # modified Lentz continued fraction of the upper part
            zr, s = z[rest], a[rest]
            b = zr + 1 - s
            c, d = np.full_like(zr, 1e300), 1 / b
            h = d.copy()
            for n in range(1, 1000):
                an = -n * (n - s)
                b = b + 2
                d = an * d + b
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = b + an / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                h = h * d * c
                if np.all(np.abs(d * c - 1) < 1e-15):
                    break
            out[rest] = 1 - front[rest] * h
    return out


def gamma_ppf(p: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """By bisection on a doubling bracket."""
    p, alpha, beta = (np.array(z, float) for z in np.broadcast_arrays(p, alpha, beta))
    valid = (alpha > 0) & (beta > 0) & (p >= 0) & (p < 1)
    a, b = np.where(valid, alpha, 1), np.where(valid, beta, 1)
    low, high = np.zeros(p.shape), a * b + 1e-12
    for _ in range(200):
        short = valid & (gamma_cdf(high, a, b) < p)
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    for _ in range(120):
        middle = (low + high) / 2
        below = gamma_cdf(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return np.where(valid, (low + high) / 2, np.where((alpha > 0) & (beta > 0) & (p == 1), np.inf, np.nan))


def _column(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        out = pd.Series(function(*(p.to_numpy(float) for p in parts)))
        return out.where(out.notna(), None)

    return run(*columns)


def cdf(value: Column, dist: str = "norm", alpha: Column | None = None, beta: Column | None = None) -> Column:
    """Distribution function of 'norm' (standard) or 'gamma' (with alpha, beta); NULL stays NULL."""
    return _column(norm_cdf, value) if dist == "norm" else _column(gamma_cdf, value, alpha, beta)


def ppf(p: Column, dist: str = "norm", alpha: Column | None = None, beta: Column | None = None) -> Column:
    return _column(norm_ppf, p) if dist == "norm" else _column(gamma_ppf, p, alpha, beta)
