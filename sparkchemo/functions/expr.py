"""Column expressions that models are made of; parameters enter as literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: Sequence[Column]) -> Column:
    """The sum of columns, added from the left."""
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def linear(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """The dot product with constant weights."""
    return total([c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def quadratic(columns: Sequence[Column], matrix) -> Column:
    """x' M x for a constant matrix."""
    return total([c * linear(columns, row) for c, row in zip(columns, matrix, strict=True)])


def inlier_probability(x: Column) -> Column:
    """The logistic function of a decision value; below -500 it is flat."""
    return 1 / (1 + F.exp(-F.greatest(x, F.lit(-500.0))))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def _erfc(z: Column) -> Column:
    """The complementary error function of z >= 0: its series below 2.5, a continued fraction above."""
    square = F.exp(-z * z) / math.sqrt(math.pi)
    series = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(1.0), lambda s, k: 1 + s * 2 * z * z / (2 * k + 1))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda s, k: z + k / 2 / s)
    return F.when(z < 2.5, 1 - 2 * z * square * series).otherwise(square / fraction)


def chi2_tail(x: Column, dof: int) -> Column:
    """The probability that a chi-squared value with ``dof`` degrees exceeds ``x``: a finite sum, with an error function if dof is odd."""
    half = F.greatest(x, F.lit(0.0)) / 2
    m = dof // 2
    descending = F.sequence(F.lit(m - 1), F.lit(1), F.lit(-1)) if m > 1 else None
    if dof % 2 == 0:
        terms = F.aggregate(descending, F.lit(1.0), lambda s, j: 1 + s * half / j) if m > 1 else F.lit(1.0)
        tail = F.exp(-half) * terms
    else:
        terms = F.aggregate(descending, F.lit(1.0), lambda s, j: 1 + s * half / (j + 0.5)) if m > 1 else F.lit(1.0)
        tail = _erfc(F.sqrt(half)) + (F.exp(-half) * F.sqrt(half) * (2 / math.sqrt(math.pi)) * terms if m else 0.0)
    return F.when(half > 700, 0.0).otherwise(tail)  # beyond, the sum would not fit a double and the tail is nothing
