"""Column scalers: statistics by aggregates, application by expressions with literals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.quantiles import quantiles


@dataclass(frozen=True)
class ScalerModel:
    columns: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - center) / scale for every column; null where the scale is 0."""
        return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, m, s in zip(self.columns, self.center, self.scale, strict=True)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, m, s in zip(self.columns, self.center, self.scale, strict=True)})


@dataclass(frozen=True)
class CorrectedScaler:
    """Mean and standard deviation (n - 1 unless ``biased``); ``pareto`` divides by the deviation's root."""

    columns: Sequence[str]
    with_mean: bool = True
    with_std: bool = True
    pareto: bool = False
    biased: bool = False

    def fit(self, df: DataFrame) -> ScalerModel:
        std = F.stddev_pop if self.biased else F.stddev_samp
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in self.columns], *[std(c).alias(f"s_{c}") for c in self.columns]).first()
        scale = []
        for c in self.columns:
            s = row[f"s_{c}"]
            if self.with_std and (s is None or s < 1e-18):
                raise ValueError(f"{c} does not vary")
            scale.append((math.sqrt(s) if self.pareto else s) if self.with_std else 1.0)
        return ScalerModel(tuple(self.columns), tuple(row[f"m_{c}"] if self.with_mean else 0.0 for c in self.columns), tuple(scale))


@dataclass(frozen=True)
class RobustScaler:
    """Exact median and exact range between two percentiles, linearly interpolated."""

    columns: Sequence[str]
    with_median: bool = True
    with_iqr: bool = True
    pareto: bool = False
    rng: tuple[float, float] = (25, 75)

    def fit(self, df: DataFrame) -> ScalerModel:
        at = [0.5, self.rng[0] / 100, self.rng[1] / 100]
        row = quantiles(df, {c: F.col(c) for c in self.columns}, at)
        center = tuple(row[c][0] if self.with_median else 0.0 for c in self.columns)
        width = [row[c][2] - row[c][1] if self.with_iqr else 1.0 for c in self.columns]
        return ScalerModel(tuple(self.columns), center, tuple(math.sqrt(w) if self.pareto and self.with_iqr else w for w in width))
