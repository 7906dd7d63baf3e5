"""Row filters for spectra held as ARRAY<DOUBLE>: each is an expression of one array column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def array_mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def array_quantile(x: Column, q: float) -> Column:
    """Linear interpolation between the neighbours of (n - 1) q."""

    def at(s: Column) -> Column:
        place = (F.size(s) - 1) * F.lit(float(q))
        low = F.floor(place).cast("int")
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return a + (b - a) * (place - low)

    return _let(F.array_sort(x), at)


def snv(x: Column, robust: bool = False, detrend: bool = False, q: float = 50, length: int | None = None) -> Column:
    """Centre and scale a spectrum by its own mean and deviation (n - 1), or robustly by quantile and quartile range.

    ``detrend`` then takes off a parabola fitted over the index; it needs the fixed ``length``.
    """
    if not 0 < q < 100:
        raise ValueError("q lies between 0 and 100")
    if robust:
        center, scale = array_quantile(x, q / 100), array_quantile(x, 0.75) - array_quantile(x, 0.25)
    else:
        center = array_mean(x)
        scale = _let(center, lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size(x) - 1)))
    out = _let(F.struct(center.alias("c"), scale.alias("s")), lambda p: F.transform(x, lambda v: F.try_divide(v - p["c"], p["s"])))
    return polynomial_detrend(out, length, 2) if detrend else out


def polynomial_detrend(x: Column, length: int, degree: int = 2) -> Column:
    """``x`` less its least-squares polynomial over the index: a constant matrix gives the coefficients."""
    basis, _ = np.linalg.qr(np.vander(np.linspace(-1, 1, length), degree + 1))
    rows = [F.array(*[F.lit(float(v)) for v in b]) for b in basis.T]

    def rest(y: Column) -> Column:
        weights = [F.aggregate(F.zip_with(y, r, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) for r in rows]
        fitted = y
        for w, r in zip(weights, rows, strict=True):
            fitted = F.zip_with(fitted, r, _less(w))
        return fitted

    return _let(x, rest)


def _less(weight: Column):
    return lambda a, b: a - weight * b


def clip_renormalise_log(x: Column, start: int, stop: int, floor: float = 1e-7) -> Column:
    """The part [start, stop) of a spectrum divided by its sum, then logarithms of at least ``floor``."""
    return _let(F.slice(x, start + 1, stop - start), lambda y: _let(array_sum(y), lambda s: F.transform(y, lambda v: F.log(F.greatest(F.try_divide(v, s), F.lit(floor))))))


@dataclass(frozen=True)
class MSCModel:
    reference: tuple[float, ...]

    def transform(self, x: Column) -> Column:
        """(x - intercept) / slope of the regression of x on the reference."""
        ref = np.array(self.reference)
        mean, ss = float(ref.mean()), float(((ref - ref.mean()) ** 2).sum())
        centred = F.array(*[F.lit(float(v - mean)) for v in ref])
        slope = F.aggregate(F.zip_with(x, centred, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / ss
        return _let(F.struct(slope.alias("b"), array_mean(x).alias("m")), lambda p: F.transform(x, lambda v: F.try_divide(v - p["m"], p["b"]) + mean))


def fit_msc(df: DataFrame, column: str, reference: list[float] | None = None) -> MSCModel:
    """The reference is the mean spectrum of the rows unless given."""
    if reference is None:
        rows = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()
        reference = [r["m"] for r in rows]
    return MSCModel(tuple(reference))


def savgol_weights(window: int, order: int, deriv: int = 0, delta: float = 1.0, at: int | None = None) -> np.ndarray:
    """Weights of the fitted polynomial's ``deriv``-th derivative at place ``at`` of a window (its middle unless given)."""
    place = (window // 2 if at is None else at)
    fit = np.linalg.pinv(np.vander(np.arange(window) - place, order + 1, increasing=True))
    return fit[deriv] * math.factorial(deriv) / delta**deriv if deriv <= order else np.zeros(window)


def savgol(x: Column, length: int, window: int, order: int, deriv: int = 0, delta: float = 1.0, mode: str = "interp", cval: float = 0.0) -> Column:
    """Savitzky-Golay smoothing of a spectrum of fixed ``length``.

    ``interp`` fits the first and last windows at the edges; mirror, nearest, wrap and
    constant extend the spectrum instead.
    """
    if window % 2 == 0 or order >= window or (mode == "interp" and window > length):
        raise ValueError("the window is odd, longer than the order, and no longer than the spectrum")
    m = window // 2
    w = savgol_weights(window, order, deriv, delta)

    def point(y: Column, i: int) -> Column:
        if mode == "interp":
            start = min(max(i - m, 0), length - window)
            places, weights = range(start, start + window), savgol_weights(window, order, deriv, delta, i - start)
        else:
            places, weights = [_outside(k, length, mode) for k in range(i - m, i + m + 1)], w
        terms = [(F.get(y, F.lit(k)) if k is not None else F.lit(cval)) * F.lit(float(c)) for k, c in zip(places, weights, strict=True)]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def whole(y: Column) -> Column:
        weights = F.array(*[F.lit(float(c)) for c in w])
        inner = F.transform(F.sequence(F.lit(m), F.lit(length - m - 1)), lambda i: F.aggregate(F.zip_with(F.slice(y, i - m + 1, window), weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v))
        edge = [point(y, i) for i in range(m)], [point(y, i) for i in range(length - m, length)]
        return F.concat(F.array(*edge[0]), inner, F.array(*edge[1])) if m else inner

    return _let(x, whole)


def _outside(k: int, n: int, mode: str) -> int | None:
    if 0 <= k < n:
        return k
    if mode == "mirror":
        k %= 2 * n - 2
        return k if k < n else 2 * n - 2 - k
    return {"nearest": min(max(k, 0), n - 1), "wrap": k % n, "constant": None}[mode]


def gramian_field(x: Column, difference: bool = False) -> Column:
    """The Gramian angular field of a spectrum, an array of rows: values rescaled to [-1, 1] are cosines of angles.

    Entry (i, j) is the cosine of the sum of two places' angles, or the sine of their
    difference. A constant spectrum, which has no scale, gives null.
    """

    def field(v: Column) -> Column:
        low, high = F.array_min(v), F.array_max(v)
        scaled = F.transform(v, lambda a: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(2 * a - low - high, high - low))))
        pairs = F.transform(scaled, lambda c: F.struct(c.alias("c"), F.sqrt(1 - c * c).alias("s")))
        entry = (lambda a, b: a["s"] * b["c"] - a["c"] * b["s"]) if difference else (lambda a, b: a["c"] * b["c"] - a["s"] * b["s"])
        made = _let(pairs, lambda p: F.transform(p, lambda a: F.transform(p, lambda b: entry(a, b))))
        return F.when(high > low, made)

    return _let(x, field)


def image_table(
    df: DataFrame, key: str, spectrum: str, label: str, start: int = 0, stop: int | None = None, test_size: float = 0.0, exclude: Sequence[str] = (), renormalise: bool = True, difference: bool = False, seed: int = 42
) -> DataFrame:
    """(key, label, code, split, spectrum, image): spectra made images in one lazy plan.

    Classes of ``exclude`` go; the part [start, stop) of a spectrum, with ``renormalise`` divided by its sum, becomes
    logarithms and these a Gramian angular field, each from its own spectrum alone. Each class is split alike: of its
    rows, in the order of a hash of the key, the last ``test_size`` share, rounded up, is 'test'. ``code`` numbers the classes that are left by name. Rows without label or spectrum are left out, and
    spectra without a sum or all alike give a null image.
    """
    from sparkchemo.operators.comparison import in_random_order
    from sparkchemo.operators.explain import encode_labels

    if stop is not None and start >= stop:
        raise ValueError("the range goes from low to high")
    if not 0 <= test_size < 1:
        raise ValueError("test_size is a share below 1")
    rows = df.select(key, F.col(spectrum).alias("_x"), label).dropna()
    rows = encode_labels(rows.where(~F.col(label).isin(list(exclude))) if exclude else rows, label)
    size = (F.lit(stop) if stop is not None else F.size("_x")) - start
    rows = rows.withColumn("split", F.lit("train"))
    if test_size:
        placed = in_random_order(rows.drop("split"), label, [key], seed)
        n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # a row a class
        rows = placed.join(F.broadcast(n), label).withColumn("split", F.when(F.col("_k") >= F.col("_n") - F.ceil(F.col("_n") * test_size), "test").otherwise("train"))
    part = F.slice("_x", start + 1, size)
    log = lambda x: F.transform(x, lambda v: F.log(F.greatest(v, F.lit(1e-7))))
    made = _let(part, lambda y: _let(array_sum(y), lambda s: log(F.transform(y, lambda v: F.try_divide(v, s))))) if renormalise else log(part)
    rows = rows.select(key, label, "code", "split", made.alias("spectrum"))
    return rows.withColumn("image", gramian_field(F.col("spectrum"), difference))
