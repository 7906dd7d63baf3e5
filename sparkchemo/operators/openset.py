"""Open-set recognition: out-of-distribution scores with thresholds, and a gate before a classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.expr import linear, total
from sparkchemo.functions.quantiles import ordered_quantile
from sparkchemo.operators.moments import moments
from sparkchemo.operators.projection import principal_axes


def log_sum_exp(x: Column, temperature: float = 1.0) -> Column:
    """T log(sum(exp(x / T))) of an array, shifted by its greatest value."""
    top = F.array_max(x)
    return F.get(F.transform(F.array(top), lambda m: m + temperature * F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp((v - m) / temperature)))), 0)


def softmax(x: Column) -> Column:
    return F.get(F.transform(F.array(log_sum_exp(x)), lambda s: F.transform(x, lambda v: F.exp(v - s))), 0)


def softmax_score(x: Column) -> Column:
    """The greatest probability."""
    return F.exp(F.array_max(x) - log_sum_exp(x))


def energy_score(x: Column, temperature: float = 1.0) -> Column:
    return log_sum_exp(x, temperature)


def arg_max(x: Column) -> Column:
    """The first place (from 0) of an array's greatest value."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


@dataclass(frozen=True)
class Threshold:
    """Inlier if score >= cut, where cut is the alpha quantile of training scores by the lower rank."""

    score: Callable[[], Column]
    cut: float

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("ood_score", self.score()).withColumn("inlier", F.col("ood_score") >= F.lit(self.cut))


def fit_threshold(df: DataFrame, score: Callable[[], Column], alpha: float = 0.05) -> Threshold:
    return Threshold(score, ordered_quantile(df.select(score().alias("s")), "s", alpha, "lower"))


def dime_score(df: DataFrame, columns: Sequence[str], rank: int) -> Callable[[], Column]:
    """Minus the distance to the plane through the training mean along the ``rank`` main axes."""
    m = moments(df, columns)
    _, axes = principal_axes(m.covariance, rank)
    off = np.eye(len(columns)) - axes @ axes.T

    def score() -> Column:
        x = [F.col(c) - F.lit(float(v)) for c, v in zip(columns, m.mean, strict=True)]
        return -F.sqrt(F.greatest(F.lit(0.0), total([F.pow(linear(x, row), 2) for row in off])))

    return score


@dataclass(frozen=True)
class OpenSet:
    """Rows that the gate takes get the classifier's answer, others the unknown class."""

    gate: Callable[[DataFrame], DataFrame]
    classify: Callable[[DataFrame], DataFrame]
    unknown: str = "Unknown"

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``inlier`` (by the gate) and ``predicted`` (by the classifier, a string or an array)."""
        out = self.classify(self.gate(df))
        other = F.array(F.lit(self.unknown)) if out.schema["predicted"].dataType.typeName() == "array" else F.lit(self.unknown)
        return out.withColumn("predicted", F.when(F.col("inlier"), F.col("predicted")).otherwise(other))


def fit_open_set(df: DataFrame, label: str, known: Sequence[str], fit_gate, fit_classifier, unknown: str = "Unknown") -> OpenSet:
    """The gate is fitted on known rows, the classifier on those that the gate takes; two classes must be left."""
    if unknown in known:
        raise ValueError("the unknown class is a known one")
    rows = df.where(F.col(label).isin(list(known)))
    gate = fit_gate(rows)
    inside = gate(rows).where("inlier").drop("inlier")
    if inside.select(label).distinct().count() < 2:
        raise ValueError("fewer than two classes are left inside the gate")
    return OpenSet(gate, fit_classifier(inside), unknown)


def nearest_centroid(df: DataFrame, columns: Sequence[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """A classifier by the nearest class mean, in columns divided by their deviation; ties go to the first name."""
    s = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    rows = df.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns]).orderBy(label).collect()
    far = [F.struct(total([F.pow((F.col(c) - F.lit(r[c])) / F.lit(s[c]), 2) for c in columns]).alias("d"), F.lit(r[label]).alias("cls")) for r in rows]
    return lambda x: x.withColumn("predicted", F.array_min(F.array(*far))["cls"])
