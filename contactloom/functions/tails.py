"""Upper tails P(X >= k) of Poisson, binomial and hypergeometric counts and of chi-square, and corrections for many tests.

The tails are summed term by term over whole numpy arrays, from logarithms of the
first term, and floored at 1e-300. A count that is no whole number is rounded
down. k <= 0 gives 1; a rate or probability of 0 and counts out of reach give the
floor; a null parameter gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

FLOOR = 1e-300
_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight places up."""
    x = np.asarray(x, dtype=float)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - low


def _tail(k: np.ndarray, log_first: np.ndarray, mean: np.ndarray, up: Callable, down: Callable) -> np.ndarray:
    """Sums P(X >= k) from P(X = k): ``up(i)`` and ``down(i)`` are P(i + 1) / P(i) and P(i - 1) / P(i) of all rows.

    Above the mean terms fall from the first one on; below it the rest is
    summed downwards and taken from one.
    """
    high = k > mean
    total, term, i = np.where(high, 1.0, 0.0), np.ones_like(k), k.copy()
    live = np.isfinite(log_first)
    while live.any():
        ratio = np.where(high, up(i), down(i))
        term = np.where(live, term * ratio, 0.0)
        total = total + term
        i = np.where(high, i + 1, i - 1)
        live = live & (term > 1e-17 * (total + ~high)) & (high | (i > 0))
    part = np.exp(np.minimum(log_first, 700.0)) * total
    return np.where(high, part, 1 - part)


def _floored(tail: np.ndarray, one: np.ndarray, none: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    out = np.where(one, 1.0, np.where(none, FLOOR, np.clip(tail, FLOOR, 1.0)))
    return np.where(unknown, np.nan, out)


def _arrays(*values) -> tuple[list[np.ndarray], np.ndarray]:
    arrays = [np.array(v, dtype=float, ndmin=1) for v in np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in values])]
    return arrays, np.any([np.isnan(a) for a in arrays], axis=0)


def poisson_tail(k, mu) -> np.ndarray:
    (k, mu), unknown = _arrays(k, mu)
    k = np.floor(k)
    one, none = k <= 0, mu <= 0
    bad = one | none | unknown
    a, m = np.where(bad, 1.0, k), np.where(bad, 1.0, mu)
    log = -m + a * np.log(m) - log_gamma(a + 1)
    return _floored(_tail(a, log, m, lambda i: m / (i + 1), lambda i: i / m), one, none & ~one, unknown)


def binomial_tail(k, n, p) -> np.ndarray:
    (k, n, p), unknown = _arrays(k, n, p)
    k, n = np.floor(k), np.floor(n)
    one, none = (k <= 0) | ((p >= 1) & (k <= n)), (p <= 0) | (k > n)
    bad = one | none | unknown
    a, m, q = np.where(bad, 1.0, k), np.where(bad, 2.0, n), np.where(bad, 0.5, p)
    odds = q / (1 - q)
    log = log_gamma(m + 1) - log_gamma(a + 1) - log_gamma(m - a + 1) + a * np.log(q) + (m - a) * np.log1p(-q)
    up, down = (lambda i: np.maximum(m - i, 0) / (i + 1) * odds), (lambda i: i / ((m - i + 1) * odds))
    return _floored(_tail(a, log, m * q, up, down), one, none & ~one, unknown)


def hypergeometric_tail(k, total, marked, drawn) -> np.ndarray:
    """At least ``k`` marked ones among ``drawn`` of ``total``, ``marked`` of which are marked."""
    (k, t, r, d), unknown = _arrays(np.floor(k), np.floor(total), np.floor(marked), np.floor(drawn))
    least = np.maximum(0, r + d - t)
    one, none = k <= least, k > np.minimum(r, d)
    bad = one | none | unknown
    k, t, r, d = np.where(bad, 1.0, k), np.where(bad, 4.0, t), np.where(bad, 2.0, r), np.where(bad, 2.0, d)

    def choose(n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1)

    log = choose(r, k) + choose(t - r, d - k) - choose(t, d)
    up = lambda i: np.maximum(r - i, 0) * np.maximum(d - i, 0) / ((i + 1) * np.maximum(t - r - d + i + 1, 1))
    down = lambda i: i * np.maximum(t - r - d + i, 0) / ((r - i + 1) * (d - i + 1))
    return _floored(_tail(k, log, r * d / t, up, down), one, none & ~one, unknown)


def chi_square_tail(d) -> np.ndarray:
    """One degree of freedom."""
    (d,), unknown = _arrays(d)
    return _floored(_erfc(np.sqrt(np.where(unknown, 0.0, np.maximum(d, 0)) / 2)).astype(float), d <= 0, np.zeros(len(d), bool), unknown)


@F.pandas_udf(DoubleType())
def poisson_sf(k: pd.Series, mu: pd.Series) -> pd.Series:
    return pd.Series(poisson_tail(k, mu))


@F.pandas_udf(DoubleType())
def binomial_sf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_tail(k, n, p))


@F.pandas_udf(DoubleType())
def hypergeometric_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(hypergeometric_tail(k, total, marked, drawn))


@F.pandas_udf(DoubleType())
def chi_square_sf(d: pd.Series) -> pd.Series:
    return pd.Series(chi_square_tail(d))


def bonferroni(p: Column, n: Column) -> Column:
    """Corrected for n tests, at most 1."""
    return F.least(p * n, F.lit(1.0))


def harmonic(values: Column) -> Column:
    """Harmonic mean of an array of p-values."""
    return F.size(values) / F.aggregate(F.transform(values, lambda v: 1 / v), F.lit(0.0), lambda a, v: a + v)


def ma_norm(rows: DataFrame, target: str, control: str) -> DataFrame:
    """The line that maps the target's log2 counts onto the control's: beta and alpha."""
    t, c = F.log2(F.col(target) + 1), F.log2(F.col(control) + 1)
    out = rows.agg(F.stddev_pop(c).alias("sc"), F.stddev_pop(t).alias("st"), F.avg(c).alias("mc"), F.avg(t).alias("mt"))
    beta = F.try_divide("sc", F.nullif("st", F.lit(0.0)))
    return out.select(F.round(beta, 6).alias("beta"), F.round(F.col("mc") - beta * F.col("mt"), 6).alias("alpha"))


def mahalanobis(rows: DataFrame, a: str, b: str, where: Column | None = None) -> DataFrame:
    """``rows`` with d2, the squared distance of (a, b) from the centre in units of the covariance, and its p-value.

    Centre and covariance come from the rows that meet ``where`` (all, if none is given). Null where the covariance has no inverse.
    """
    of = rows if where is None else rows.where(where)
    m = of.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"), F.covar_samp(a, b).alias("_c"))
    da, db = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    det = F.nullif(F.col("_va") * F.col("_vb") - F.col("_c") * F.col("_c"), F.lit(0.0))
    d2 = (da * da * F.col("_vb") - 2 * da * db * F.col("_c") + db * db * F.col("_va")) / det
    # one row of moments
    return rows.join(F.broadcast(m)).withColumn("d2", d2).drop("_ma", "_mb", "_va", "_vb", "_c").withColumn("p", chi_square_sf("d2"))


def two_pass_mahalanobis(rows: DataFrame, a: str, b: str, pcut: float = 0.01) -> DataFrame:
    """The distances of all rows from the centre of those that a first pass leaves within ``pcut``."""
    first = mahalanobis(rows, a, b)
    return mahalanobis(first.withColumnRenamed("p", "_p").drop("d2"), a, b, F.col("_p") >= pcut).drop("_p")
