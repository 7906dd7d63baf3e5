"""Imputers: below the detection limit, by column means, and by low-rank models in rounds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.expr import linear, uniform
from sparkchemo.operators.moments import Moments, grouped_moments
from sparkchemo.operators.projection import kernel_pls, principal_axes


def missing(column: str, marker: float | None = None):
    c = F.col(column)
    out = c.isNull() | F.isnan(c.cast("double"))
    return out if marker is None else out | (c == F.lit(marker))


def below_limit(df: DataFrame, limits: dict[str, float], keys: Sequence[str], seed: int = 0, marker: float | None = None, ignore: float | None = None) -> DataFrame:
    """Values that are missing or below their limit become uniform numbers under it.

    The number depends on the seed, the row's ``keys`` and the column, so it is the same
    in every run and partitioning. A value equal to ``ignore`` stays unless it is missing.
    """
    if any(v < 0 for v in limits.values()):
        raise ValueError("a detection limit is negative")
    out = {}
    for c, limit in limits.items():
        low = missing(c, marker) | (F.col(c) < limit)
        if ignore is not None:
            low = missing(c, marker) | ((F.col(c) < limit) & (F.col(c) != ignore))
        out[c] = F.when(low, uniform(seed, *[F.col(k) for k in keys], F.lit(c)) * limit).otherwise(F.col(c))
    return df.withColumns(out)


def fill_means(df: DataFrame, columns: Sequence[str], marker: float | None = None) -> DataFrame:
    """Missing values become the mean of their column in this very table."""
    seen = {c: F.when(~missing(c, marker), F.col(c)) for c in columns}
    row = df.agg(*[F.avg(x).alias(c) for c, x in seen.items()]).first()
    return df.withColumns({c: F.coalesce(x, F.lit(row[c])) for c, x in seen.items()})


@dataclass(frozen=True)
class LowRankModel:
    columns: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    rebuild: np.ndarray
    rounds: int

    def reconstruct(self, suffix: str = "") -> dict:
        x = [(F.col(c + suffix) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]
        t = [linear(x, r) for r in self.project.T]
        return {c: linear(t, row) * F.lit(float(s)) + F.lit(float(m)) for c, row, m, s in zip(self.columns, self.rebuild, self.mean, self.scale, strict=True)}

    def transform(self, df: DataFrame, marker: float | None = None) -> DataFrame:
        """Missing values of new rows: filled with these rows' means, then rebuilt by the trained model."""
        flags = df.withColumns({f"_was_{c}": missing(c, marker) for c in self.columns})
        filled = fill_means(flags, self.columns, marker)
        made = filled.withColumns({f"_new_{c}": v for c, v in self.reconstruct().items()})
        out = made.withColumns({c: F.when(F.col(f"_was_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in self.columns})
        return out.drop(*[f"_was_{c}" for c in self.columns], *[f"_new_{c}" for c in self.columns])

    def sse(self, df: DataFrame, marker: float | None = None) -> DataFrame:
        """Minus the squared error of rebuilding the observed values."""
        made = fill_means(df.withColumns({f"_was_{c}": missing(c, marker) for c in self.columns}), self.columns, marker)
        terms = [F.sum(F.when(~F.col(f"_was_{c}"), F.pow(F.col(c) - v, 2)).otherwise(0.0)) for c, v in self.reconstruct().items()]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return made.agg((-total).alias("score"))


@dataclass(frozen=True)
class _Pattern:
    """Rows that lack the same columns: moments of what they have (0 elsewhere, y last), and their filled values as ``a`` z + ``b``."""

    gone: np.ndarray
    seen: Moments
    a: np.ndarray
    b: np.ndarray

    def filled(self) -> Moments:
        p = len(self.b)
        t = np.eye(len(self.seen.mean))
        t[:p, :p] = self.a
        mean = t @ self.seen.mean
        mean[:p] += self.b
        return Moments(self.seen.columns, self.seen.n, mean, t @ self.seen.products @ t.T)


@dataclass(frozen=True)
class LowRankImputer:
    """Mean fill, then rounds of {standardise, low-rank fit, rebuild the missing values} until they settle.

    ``y`` None fits principal axes (deviations over n), else PLS directions towards ``y``
    (deviations over n - 1). Rounds settle when no value's change differs from the one before
    by ``tol`` or more. A rebuilt value is a linear function of what its row has, the same for
    all rows that lack the same columns, so a round needs only the moments of each such
    pattern, which one aggregate gives; rows are read again only to see that the largest
    change is small, once the mean square one is.
    """

    columns: Sequence[str]
    y: str | None = None
    n_components: int = 1
    scale: bool = True
    max_rounds: int = 5000
    tol: float = 1e-6

    def fit(self, df: DataFrame, marker: float | None = None) -> LowRankModel:
        columns, p = list(self.columns), len(self.columns)
        names = [*columns, *([self.y] if self.y else [])]
        lacks = [missing(c, marker) for c in columns]
        pattern = F.concat(*[F.when(x, "1").otherwise("0") for x in lacks])
        z = df.select(pattern.alias("_pattern"), *[F.when(~x, F.col(c)).otherwise(0.0).cast("double").alias(c) for c, x in zip(columns, lacks, strict=True)], *names[p:])
        groups = {k: m for (k,), m in grouped_moments(z, names, ["_pattern"]).items()}
        here = {k: np.array([c == "0" for c in k]) for k in groups}
        count = sum(m.n * here[k] for k, m in groups.items())
        mean = sum(m.n * m.mean[:p] * here[k] for k, m in groups.items()) / np.maximum(count, 1)
        state = {k: _Pattern(~here[k], m, np.diag(here[k].astype(float)), np.where(here[k], 0.0, mean)) for k, m in groups.items()}
        # A change is an affine function of the row too; before the first round the filled values themselves stand for it.
        change = {k: (s.a, s.b) for k, s in state.items()}
        for rounds in range(1, self.max_rounds + 1):
            whole = None
            for s in state.values():
                whole = s.filled() if whole is None else whole + s.filled()
            model = self._model(whole, rounds)
            g = (model.rebuild @ model.project.T) * np.outer(model.scale, 1 / model.scale)
            after, moved = {}, {}
            for k, s in state.items():
                a, b = np.where(s.gone[:, None], g @ s.a, s.a), np.where(s.gone, g @ (s.b - model.mean) + model.mean, s.b)
                after[k] = replace(s, a=a, b=b)
                moved[k] = (a - s.a, b - s.b)
            turn = {k: ((moved[k][0] - change[k][0])[s.gone], (moved[k][1] - change[k][1])[s.gone]) for k, s in state.items() if s.gone.any()}
            state, change = after, moved
            size = max((self._root_mean_square(d, e, groups[k], p) for k, (d, e) in turn.items()), default=0.0)
            if size < self.tol and (not turn or self._largest(z, columns, turn) < self.tol):
                return model
        raise RuntimeError(f"the imputer did not settle in {self.max_rounds} rounds")

    @staticmethod
    def _root_mean_square(d: np.ndarray, e: np.ndarray, m: Moments, p: int) -> float:
        return float(np.sqrt(((d @ m.mean[:p] + e) ** 2 + np.einsum("ij,jk,ik->i", d, m.products[:p, :p], d) / m.n).max()))

    @staticmethod
    def _with_turns(z: DataFrame, columns: list[str], turn: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(_pattern, x, d, e): the rows with what changes those of their pattern; no row is shuffled, patterns have all rows between a few."""
        rows = [(k, d.tolist(), e.tolist()) for k, (d, e) in turn.items()]
        table = z.sparkSession.createDataFrame(rows, "_pattern string, d array<array<double>>, e array<double>")
        return z.select("_pattern", F.array(*columns).alias("x")).join(F.broadcast(table), "_pattern")

    @classmethod
    def _largest(cls, z: DataFrame, columns: list[str], turn: dict[str, tuple[np.ndarray, np.ndarray]]) -> float:
        """The largest absolute value of d z + e over all rows, d and e by pattern."""
        x = cls._with_turns(z, columns, turn)
        dot = lambda row: F.aggregate(F.zip_with(row, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return x.agg(F.max(F.array_max(F.zip_with("d", "e", lambda row, e: F.abs(dot(row) + e)))).alias("m")).first()["m"]

    def _model(self, m: Moments, k: int) -> LowRankModel:
        p = len(self.columns)
        s = np.sqrt(np.diag(m.products)[:p] / (m.n - (1 if self.y else 0))) if self.scale else np.ones(p)
        xx = m.products[:p, :p] / np.outer(s, s)
        if self.y:
            _, project, rebuild, _ = kernel_pls(xx, (m.products[:p, p] / s)[:, None], self.n_components)
        else:
            _, project = principal_axes(xx, self.n_components)
            rebuild = project
        return LowRankModel(tuple(self.columns), m.mean[:p], s, project, rebuild, k)
