"""Exact order statistics of many columns at once, by narrowing histograms: no sort and no buffer of values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, and values of an interval that may come to the driver.
BINS, FEW = 1024, 2048
#: Infinite values count as this one in a pass, which keeps the listing apart.
MOST = 1.7e308


def order_statistics(df: DataFrame, values: dict[str, Column], ranks: Callable[[int], set[int]], bins: int = BINS, few: int = FEW) -> dict[str, tuple[int, dict[int, float]]]:
    """name -> (n, {rank: value}) of each column's values that are not null; ``ranks`` gives the ranks (from 0) for n values.

    The first pass takes ends and numbers. A further pass counts, for each interval that
    holds a wanted rank, its values by bin; the bin with the rank is the
    next interval, and how many values lie below it is known by then. An interval of at most ``few`` values is listed
    instead. What is shuffled and collected in a pass is about ``bins`` small rows for each interval; the values
    are kept for the passes where executors have room, and worked out again where not.
    """
    x = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())])
    x = x.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in x.columns]).persist()
    try:
        return _narrowed(x, list(values), ranks, bins, few)
    finally:
        x.unpersist()


def _narrowed(x: DataFrame, names: list[str], ranks: Callable[[int], set[int]], bins: int, few: int) -> dict[str, tuple[int, dict[int, float]]]:
    row = x.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    found: dict[str, tuple[int, dict[int, float]]] = {name: (row[f"n{i}"], {}) for i, name in enumerate(names)}
    open_: dict[tuple[int, float, float], tuple[int, int, set[int]]] = {}  # column, lo, hi -> values below, values inside, wanted ranks
    for i in range(len(names)):
        if row[f"n{i}"]:
            open_[i, row[f"lo{i}"], row[f"hi{i}"]] = (0, row[f"n{i}"], ranks(row[f"n{i}"]))
    while open_:
        parts = []
        for at, ((i, lo, hi), (_, inside, _)) in enumerate(open_.items()):
            v = F.col(f"v{i}")
            low, high = (min(max(e, -MOST), MOST) / 2 for e in (lo, hi))  # halves, so that no difference overflows
            half = F.least(F.greatest(v, F.lit(-MOST)), F.lit(MOST)) / 2
            place = F.least(F.lit(bins - 1), F.floor((half - low) / (high - low) * bins)).cast("double") if inside > few and high > low else v
            parts.append(F.when((v >= lo) & (v <= hi), F.struct(F.lit(at).alias("at"), place.alias("place"), v.alias("v"))))
        each = x.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")
        counts: dict[int, list] = {}
        for r in each.groupBy("at", "place").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counts.setdefault(r["at"], []).append(r)
        after: dict[tuple[int, float, float], tuple[int, int, set[int]]] = {}
        for at, ((i, _, _), (before, _, wanted)) in enumerate(open_.items()):
            for r in sorted(counts.get(at, []), key=lambda r: r["place"]):
                own = {k for k in wanted if before <= k < before + r["n"]}
                if own and r["lo"] == r["hi"]:
                    found[names[i]][1].update(dict.fromkeys(own, r["lo"]))
                elif own:
                    after.setdefault((i, r["lo"], r["hi"]), (before, r["n"], set()))[2].update(own)
                before += r["n"]
        open_ = after
    return found


def quantiles(df: DataFrame, values: dict[str, Column], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Each column's quantiles with linear interpolation between the neighbouring ranks; None without values."""
    ends = lambda n, q: (math.floor((n - 1) * q), math.ceil((n - 1) * q))
    found = order_statistics(df, values, lambda n: {k for q in qs for k in ends(n, q)})
    out: dict[str, list[float | None]] = {}
    for name, (n, at) in found.items():
        out[name] = [at[a] + (at[b] - at[a]) * ((n - 1) * q - a) if n else None for q in qs for a, b in [ends(n, q)]]
    return out


def ordered_quantile(df: DataFrame, value: str, q: float, rule: str = "lower") -> float | None:
    """A quantile by rank: the sorted element at floor((n-1)q), or the middle of it and the next."""
    ends = lambda n: (math.floor((n - 1) * q), math.floor((n - 1) * q) if rule == "lower" else math.ceil((n - 1) * q))
    n, at = order_statistics(df, {value: F.col(value)}, lambda n: set(ends(n)))[value]
    return sum(at[k] for k in ends(n)) / 2 if n else None
