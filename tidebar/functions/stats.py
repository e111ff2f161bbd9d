"""Distribution functions for small driver-side results."""

from __future__ import annotations

import math
from statistics import NormalDist


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 0.0
    f = 1.0
    for i in range(300):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_p(x: float, two_df: bool = True) -> float:
    """Upper tail for two degrees of freedom, as the Jarque-Bera test needs."""
    return math.exp(-x / 2)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
