"""Additive moments of feature columns: the one aggregate that the linear models need."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Row count, means, and centred sums of products of some columns."""

    columns: tuple[str, ...]
    n: int
    mean: np.ndarray
    products: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.products / (self.n - 1)

    def of(self, columns: Sequence[str]) -> Moments:
        at = [self.columns.index(c) for c in columns]
        return Moments(tuple(columns), self.n, self.mean[at], self.products[np.ix_(at, at)])

    def scaled(self, scale: np.ndarray) -> Moments:
        """Moments of the columns divided by ``scale``."""
        return Moments(self.columns, self.n, self.mean / scale, self.products / np.outer(scale, scale))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(self.columns, n, self.mean + gap * other.n / n, self.products + other.products + np.outer(gap, gap) * self.n * other.n / n)

    def __sub__(self, part: Moments) -> Moments:
        """The moments of the rows without ``part``: leaving out a fold costs no scan."""
        n = self.n - part.n
        mean = (self.n * self.mean - part.n * part.mean) / n
        gap = part.mean - mean
        return Moments(self.columns, n, mean, self.products - part.products - np.outer(gap, gap) * n * part.n / self.n)


#: Above so many columns products are made in blocks of rows, not by an expression each.
WIDE = 48
#: Tasks whose partial products are added up: each sends a matrix, so there are not more of them.
PARTS = 64


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over all rows without a null or NaN in ``columns``: one scan for the means, one for the centred products."""
    return next(iter(grouped_moments(df, columns, []).values()))


def grouped_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> dict[tuple, Moments]:
    """Moments per group of few groups; products are taken about the overall means, so they stay exact and additive.

    A row with a null or NaN in one of the columns counts nowhere, however many columns there are; a null key is a group.
    """
    columns = list(columns)
    df = df.dropna(subset=columns)
    if len(columns) > WIDE:
        return _in_blocks(df, columns, list(keys))
    means = df.agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_n")).first()
    if not means["_n"]:
        raise ValueError("no rows to fit on")
    shift = np.array([means[c] for c in columns], float)
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, shift, strict=True)]
    p = len(columns)
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for row in df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *sums, *products).collect():
        s, m = np.array([row[f"s{i}"] for i in range(p)], float), np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                m[i, j] = m[j, i] = row[f"p{i}_{j}"]
        out[tuple(row[k] for k in keys)] = Moments(tuple(columns), row["_n"], shift + s / row["_n"], m - np.outer(s, s) / row["_n"])
    return out


def _in_blocks(df: DataFrame, columns: list[str], keys: list[str]) -> dict[tuple, Moments]:
    """The moments of many columns: a task multiplies blocks of its rows, and the matrices are added up row by row.

    A group's matrix is held once a task, and comes to the driver, which needs it whole.
    """
    p = len(columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    if not row["n"]:
        raise ValueError("no rows to fit on")
    shift = np.array([row[f"m{i}"] for i in range(p)], float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - shift
            # Column p has ones: its products are the sums and the number of rows.
            x = np.concatenate([x, np.ones((len(x), 1))], 1)
            g = np.array(batch.column("g").to_pylist(), object)
            for key in set(g.tolist()):
                own = x[g == key]
                held[key] = held.get(key, 0) + own.T @ own
        for key, m in held.items():
            for at in range(0, p + 1, 256):
                part = m[at : at + 256]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), p + 1).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), lists], ["g", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.stack([r.values.to_numpy() for r in table.column("row")])
        return pa.table({"g": table.column("g")[:1], "i": table.column("i")[:1], "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    named = df.select(F.to_json(F.struct(*[F.col(k) for k in keys])).alias("g") if keys else F.lit("").alias("g"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    parts = named.coalesce(PARTS).mapInArrow(task, "g string, i int, row array<double>")
    sums: dict[str, np.ndarray] = {}
    for r in parts.groupBy("g", "i").applyInArrow(add, "g string, i int, row array<double>").toLocalIterator():
        sums.setdefault(r["g"], np.zeros((p + 1, p + 1)))[r["i"]] = r["row"]
    names = {r["_g"]: tuple(r[k] for k in keys) for r in df.select(*keys, F.to_json(F.struct(*[F.col(k) for k in keys])).alias("_g")).distinct().collect()} if keys else {"": ()}
    out = {}
    for g, m in sums.items():
        n, s = int(round(m[p, p])), m[p, :p]
        out[names[g]] = Moments(tuple(columns), n, shift + s / n, m[:p, :p] - np.outer(s, s) / n)
    return out
