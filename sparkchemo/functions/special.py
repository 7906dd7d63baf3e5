"""Distribution functions and a simplex search in plain Python: the driver-side arithmetic of the models."""

from __future__ import annotations

import math
from collections.abc import Callable


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * scale
    # Lentz's continued fraction of the upper function.
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / _nonzero(an * d + b)
        c = _nonzero(b + an / c)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / _nonzero(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / _nonzero(1 + num * d)
            c = _nonzero(1 + num / c)
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def _nonzero(x: float) -> float:
    return x if abs(x) > 1e-300 else 1e-300


def _invert(cdf: Callable[[float], float], p: float, guess: float) -> float:
    """The positive x with cdf(x) = p, by bracketing and bisection to full precision."""
    low, high = 0.0, max(guess, 1e-8)
    while cdf(high) < p:
        low, high = high, high * 2
        if high > 1e300:
            return math.inf
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def chi2_ppf(p: float, dof: float) -> float:
    """Quantile of the chi-squared distribution; ``dof`` may be any positive number."""
    if p >= 1:
        return math.inf
    return _invert(lambda x: gamma_p(dof / 2, x / 2), p, dof) if p > 0 else 0.0


def f_ppf(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution."""
    return _invert(lambda x: beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)), p, 1.0) if 0 < p < 1 else (0.0 if p <= 0 else math.inf)


def t_cdf(t: float, dof: float) -> float:
    """Distribution function of Student's t."""
    tail = 0.5 * beta_i(dof / 2, 0.5, dof / (dof + t * t))
    return 1 - tail if t > 0 else tail


def binomial_sf(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) of a binomial."""
    return 1.0 if k <= 0 else beta_i(k, n - k + 1, p) if k <= n else 0.0


def minimise_1d(f: Callable[[float], float], start: float, tol: float = 1e-4, limit: int = 200) -> tuple[float, bool]:
    """Nelder-Mead in one dimension: (place, whether it converged). The simplex begins 5 % wide."""
    points = sorted([(f(x), x) for x in (start, start * 1.05 if start else 0.00025)])
    calls = 2
    for _ in range(limit):
        (fa, a), (fb, b) = points
        if abs(a - b) <= tol and abs(fa - fb) <= tol:
            return a, True
        x = 2 * a - b  # reflected
        fx = f(x)
        calls += 1
        if fx < fa:
            y = 3 * a - 2 * b  # expanded
            fy = f(y)
            calls += 1
            new = (fy, y) if fy < fx else (fx, x)
        else:
            y = 1.5 * a - 0.5 * b if fx < fb else (a + b) / 2  # contracted, outside or inside
            fy = f(y)
            calls += 1
            good = fy <= fx if fx < fb else fy < fb
            new = (fy, y) if good else (f(a + 0.5 * (b - a)), a + 0.5 * (b - a))
        points = sorted([(fa, a), new])
        if calls >= limit:
            return points[0][1], False
    return points[0][1], False
