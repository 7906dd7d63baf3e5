"""The minimum covariance determinant: the half of the rows whose covariance has the least determinant.

Many small random subsets start it, so that no cluster of outliers, however the middle of all rows lies,
can lead every start astray. Starts are told apart on a bounded sample; the best go on over all rows, together: a
concentration step takes one search for all starts' order statistics and one scan of sums,
whatever the number of rows. The best of them is finished, made consistent and reweighted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.expr import quadratic
from sparkchemo.functions.quantiles import order_statistics, quantiles
from sparkchemo.functions.special import chi2_ppf
from sparkchemo.operators.moments import grouped_moments

#: Rows that the starts are tried on, starts, and starts that go on over all rows.
SAMPLE, STARTS, KEPT = 2000, 500, 10


@dataclass(frozen=True)
class Shape:
    """A location and a covariance, with the squared Mahalanobis distance as a column."""

    columns: tuple[str, ...]
    location: np.ndarray
    covariance: np.ndarray

    @property
    def size(self) -> float:
        return float(np.linalg.det(self.covariance))

    def distance(self) -> Column:
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(self.columns, self.location, strict=True)]
        return quadratic(x, np.linalg.pinv(self.covariance))


def _of(x: np.ndarray, center: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    m = x.mean(0) if center is None else center
    return m, (x - m).T @ (x - m) / len(x)


def _started(x: np.ndarray, starts: int, kept: int, support: float | None, center: np.ndarray | None, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``kept`` best of ``starts`` random subsets of a sample, after concentration there."""
    n, p = x.shape
    h = half(n, p, support)
    rng = np.random.default_rng(seed)

    def step(shape: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        gap = x - shape[0]
        d = np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(shape[1]), gap)
        return _of(x[np.argpartition(d, h - 1)[:h]], center)

    found = []
    for _ in range(starts):
        own = rng.permutation(n)
        size = min(n, p + 1)
        while size < h and np.linalg.matrix_rank(np.cov(x[own[:size]].T, bias=True).reshape(p, p)) < p:
            size += 1  # a flat subset says nothing about distances off it
        shape = step(step(_of(x[own[:size]], center)))
        found.append((float(np.linalg.det(shape[1])), len(found), shape))
    out = []
    for size, _, shape in sorted(found, key=lambda f: f[:2])[:kept]:
        for _ in range(30):
            shape, last = step(shape), size
            size = float(np.linalg.det(shape[1]))
            if size >= last * (1 - 1e-12):
                break
        if not any(np.allclose(shape[0], o[0]) and np.allclose(shape[1], o[1]) for o in out):
            out.append(shape)
    return out


def half(n: int, p: int, support: float | None) -> int:
    """Rows that the covariance is taken of: just over a half, or the share ``support``."""
    return min(n, max(p + 1, math.ceil((n + p + 1) / 2) if support is None else int(n * support)))


def _concentrate(df: DataFrame, shapes: list[Shape], h: int, center: np.ndarray | None) -> list[Shape]:
    """A concentration step of all shapes at once: each takes the ``h`` rows nearest to it."""
    cuts = order_statistics(df, {str(i): s.distance() for i, s in enumerate(shapes)}, lambda n: {min(h, n) - 1})
    near = [F.when(s.distance() <= next(iter(cuts[str(i)][1].values())), F.lit(i)) for i, s in enumerate(shapes)]
    names = list(shapes[0].columns)
    each = df.select(*names, F.explode(F.array_compact(F.array(*near))).alias("_start"))
    found = grouped_moments(each, names, ["_start"])
    out = []
    for (_,), m in sorted(found.items()):
        spread = m.products / m.n
        if center is not None:
            spread = spread + np.outer(m.mean - center, m.mean - center)
        out.append(Shape(shapes[0].columns, m.mean if center is None else center, spread))
    return out


def minimum_covariance(
    df: DataFrame, columns: Sequence[str], support: float | None = None, center: Sequence[float] | None = None, seed: int = 0, starts: int = STARTS, sample: int = SAMPLE, kept: int = KEPT
) -> tuple[Shape, Shape]:
    """(raw, reweighted) shapes of ``columns``; rows with a null or NaN in one are left out.

    The raw one is of the ``half`` of the rows with the least determinant, made consistent by the median distance; the
    reweighted one is of all rows within its 97.5 % limit. With ``center`` the location is given. The starts see at
    most ``sample`` rows, the first by a hash; their concentration, the choice among them and the result see all rows.
    """
    names = list(columns)
    df = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    n, p = df.count(), len(names)
    if n < p + 2:
        raise ValueError(f"{p + 2} rows are needed")
    middle = None if center is None else np.array(center, float)
    drawn = np.array(df.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(sample).collect(), float)
    shapes = [Shape(tuple(names), *s) for s in _started(drawn, starts, kept, support, middle, seed)]
    h = half(n, p, support)
    for _ in range(2):
        shapes = _concentrate(df, shapes, h, middle)
    best = min(shapes, key=lambda s: s.size)
    for _ in range(30):
        new = _concentrate(df, [best], h, middle)[0]
        if new.size >= best.size * (1 - 1e-12):
            break
        best = new
    mid = quantiles(df, {"d": best.distance()}, [0.5])["d"][0]
    raw = Shape(best.columns, best.location, best.covariance * (mid / chi2_ppf(0.5, p)))
    inner = df.where(raw.distance() < chi2_ppf(0.975, p))
    m = grouped_moments(inner, names, [])[()]
    location, spread = (m.mean, m.products / m.n) if middle is None else (middle, m.products / m.n + np.outer(m.mean - middle, m.mean - middle))
    return raw, Shape(best.columns, location, spread)
