"""Splitters, repeated cross-validation and paired tests."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.functions.expr import total, uniform
from sparkchemo.functions.lineage import cut_lineage
from sparkchemo.functions.special import t_cdf
from sparkchemo.operators.moments import grouped_moments
from sparkchemo.operators.scaling import CorrectedScaler


def fold_of(k: int, seed: int, keys: Sequence[str]) -> Column:
    """A fold for each row by its keys: no shuffle, the same in every run."""
    return F.floor(uniform(seed, *[F.col(c) for c in keys]) * k).cast("int")


def in_random_order(df: DataFrame, label: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """``df`` with ``_k``: the place (from 0) of each row in a random order of its class.

    A class may be most of the table, so the order is by buckets of the random number: places
    before a bucket come from the buckets' sizes, and only a bucket is sorted in one task.
    """
    u = uniform(seed, *[F.col(c) for c in keys])
    buckets = max(1, df.count() // 50_000)
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(label).orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", *keys)) - 1 + F.col("_ahead")
    return rows.join(ahead, [label, "_b"]).withColumn("_k", place).drop("_u", "_b", "_ahead")


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: rows of a class are dealt in turn in a random order of their keys."""
    return in_random_order(df, label, keys, seed).withColumn("fold", (F.col("_k") % k).cast("int")).drop("_k")


#: Different counts of groups told apart by class; beyond them, counts are by their leading bits only.
KINDS = 100_000
#: A run of equal groups: places from start to before stop go to the folds in turn.
Run = tuple[int, int, list[int]]


def _even_runs(load: list[int], size: int, m: int) -> list[Run]:
    """``m`` groups of ``size`` rows, each to the fold with fewest rows so far, in closed form; ``load`` is changed.

    The folds that are not ahead by a group or more take turns until the next one is caught up with, so there
    are at most as many runs as folds and one.
    """
    runs, at = [], 0
    while at < m:
        order = sorted(range(len(load)), key=lambda i: (load[i], i))
        least, first = load[order[0]], order[0]
        if not size:
            return [*runs, (at, m, [first])]
        turn = [i for i in order if (load[i], i) < (least + size, first)]
        rounds = -(-(m - at) // len(turn))
        for i in order[len(turn) :]:  # rounds before fold i joins
            ahead = load[i] - least
            rounds = min(rounds, ahead // size - (ahead % size == 0 and i < first))
        stop = min(m, at + max(1, rounds) * len(turn))
        for j, i in enumerate(turn):
            load[i] += size * len(range(at + j, stop, len(turn)))
        runs.append((at, stop, turn))
        at = stop
    return runs


def _stratified_runs(load: np.ndarray, own: np.ndarray, totals: np.ndarray, m: int) -> list[Run]:
    """``m`` groups of ``own`` rows by class, each to the fold that leaves the classes' shares most even; ``load`` [fold, class] is changed.

    As soon as each fold has had one in turn, the differences of the loads are what they were, and so are all turns to
    come. Groups that after 64 choices a fold are still catching up go in batches that shrink to one.
    """
    k = len(load)
    runs: list[Run] = []

    def best() -> int:
        share = load / totals
        spread = [float(np.where(np.arange(k)[:, None] == f, share + own / totals, share).std(0).mean()) for f in range(k)]
        return min(range(k), key=lambda f: (round(spread[f], 12), load[f].sum(), f))

    at = 0
    while at < m:
        last = [f for *_, (f,) in runs[-k:]]
        if len(set(last)) == k and all(stop - start == 1 for start, stop, _ in runs[-k:]):
            for j, f in enumerate(last):
                load[f] += own * len(range(at + j, m, k))
            return [*runs, (at, m, last)]
        size = 1 if len(runs) < 64 * k else max(1, (m - at) // (64 * k))
        f = best()
        load[f] += own * size
        runs.append((at, at + size, [f]))
        at += size
    return runs


def _placed(groups: DataFrame, group: str, kind: list[str], runs: dict[tuple, list[Run]]) -> DataFrame:
    """(group, n, fold): groups of a kind are numbered by ``_order`` and the group, part by part of a range of them, and meet the runs."""
    spread = cut_lineage(groups.repartitionByRange(*kind, "_order", group).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part", *kind).agg(F.count(F.lit(1)).alias("_m"))
    ahead = sizes.select("_part", *kind, (F.sum("_m").over(Window.partitionBy(*kind).orderBy("_part")) - F.col("_m")).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part", *kind).orderBy("_order", group)) - 1
    numbered = spread.withColumn("_k", place).join(ahead, ["_part", *kind]).withColumn("_k", F.col("_k") + F.col("_ahead"))
    rows = [(*own, *run) for own, several in runs.items() for run in several]
    types = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in kind)
    table = groups.sparkSession.createDataFrame(rows, f"{types}, _start bigint, _stop bigint, _turn array<int>")
    met = numbered.join(F.broadcast(table) if len(rows) <= 10 * KINDS else table, kind).where("_k >= _start and _k < _stop")
    return met.select(group, "n", F.get("_turn", ((F.col("_k") - F.col("_start")) % F.size("_turn")).cast("int")).alias("fold"))


def group_folds(df: DataFrame, group: str, k: int, seed: int | None = None) -> DataFrame:
    """(group, n, fold): groups by falling size, each to the fold with fewest rows so far; ties by the group.

    With ``seed``, a repeat: sizes are as in a random 1 - 1/k of the rows, drawn for each group by its hash. Any number of
    groups: those of a size are placed in turns worked out at once, so the driver sees a row for each
    size that occurs (at most the root of twice the rows), and groups meet their turn in a join. Null is a group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    drawn = F.col("n")
    if seed is not None:
        u, v = (uniform(seed + j, F.col(group)) for j in (0, 1 << 20))
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)
        drawn = F.greatest(F.lit(0), F.least(F.col("n"), F.round(F.col("n") * (1 - 1 / k) + F.sqrt(F.col("n") * (1 - 1 / k) / k) * normal).cast("bigint")))
    sizes = sizes.withColumns({"_size": drawn, "_order": F.lit(0)})
    load, runs = [0] * k, {}
    for r in sorted(sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: -r["_size"]):
        runs[r["_size"],] = _even_runs(load, r["_size"], r["m"])
    return _placed(sizes, group, ["_size"], runs)


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int, seed: int = 0, kinds: int = KINDS) -> DataFrame:
    """(group, n, fold): whole groups, with the classes spread as evenly over the folds as a greedy choice gets them.

    Groups of the most uneven classes come first, ties in a random order; each goes to the
    fold that leaves the least deviation of the classes' shares over the folds. Groups with equal counts of all classes
    are a kind and are placed in turns worked out at once, so the driver sees a row for each kind. Where there are
    over ``kinds`` of them, counts are told apart by their first 8, 4, 2 or 1 binary digits.
    """
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    totals = {r[label]: r["n"] for r in cells.groupBy(label).agg(F.sum("n").alias("n")).collect()}
    classes = sorted(totals, key=str)
    counts = [F.coalesce(F.sum(F.when(F.col(label).eqNullSafe(F.lit(c)), F.col("n"))), F.lit(0)) for c in classes]
    groups = cells.groupBy(group).agg(F.sum("n").alias("n"), F.array(*counts).alias("_own")).withColumn("_order", uniform(seed, F.col(group)))
    groups = cut_lineage(groups)
    for bits in (None, 8, 4, 2, 1):
        step = lambda c: F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(c, F.lit(1)))) - (bits - 1)))  # noqa: B023, E731
        coarse = F.col("_own") if bits is None else F.transform("_own", lambda c: (F.floor(c / step(c)) * step(c)).cast("bigint"))  # noqa: B023
        marked = groups.withColumn("_kind", F.array_join(coarse, ","))
        if bits == 1 or marked.select("_kind").distinct().limit(kinds + 1).count() <= kinds:
            break
    means = [F.avg(F.col("_own")[i]).alias(f"c{i}") for i in range(len(classes))]
    found = [(r["_kind"], r["m"], np.array([r[f"c{i}"] for i in range(len(classes))])) for r in marked.groupBy("_kind").agg(F.count(F.lit(1)).alias("m"), *means).collect()]
    load, whole, runs = np.zeros((k, len(classes))), np.array([totals[c] for c in classes], float), {}
    for name, m, own in sorted(found, key=lambda f: (-round(float(f[2].std()), 12), zlib.crc32(f"{seed},{f[0]}".encode()))):
        runs[name,] = _stratified_runs(load, own, whole, m)
    return _placed(marked, group, ["_kind"], runs)


def repeated_folds(df: DataFrame, keys: Sequence[str], k: int, repeats: int, seed: int = 0, group: str | None = None) -> DataFrame:
    """``df`` once per repeat with (repeat, fold); with ``group``, rows of a group share a fold."""
    by = [group] if group else list(keys)
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return each.withColumn("fold", F.floor(uniform(seed, F.col("repeat"), *[F.col(c) for c in by]) * k).cast("int"))


def kennard_stone(df: DataFrame, columns: Sequence[str], key: str, n: int, every: int = 16) -> DataFrame:
    """(key, place): ``n`` rows far apart: first the one farthest from the mean, then each time the one farthest from all chosen.

    Distances are in standardised columns; ties go to the least key. The choice is sequential:
    a step is one aggregate over all rows, which carry their least distance so far, cut off
    in the shared folder each ``every`` steps. Nulls in a column leave a row out.
    """
    model = CorrectedScaler(columns).fit(df)
    x = model.transform(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])).dropna()
    gap = lambda point: total([F.pow(F.col(c) - F.lit(float(v)), 2) for c, v in zip(columns, point, strict=True)])
    rows = x.withColumn("_near", gap([0.0] * len(columns)))
    chosen: list[tuple] = []
    for place in range(n):
        r = rows.agg(F.min_by(F.struct(key, *columns, "_near"), F.struct(-F.col("_near"), F.col(key))).alias("r")).first()["r"]
        if r is None or (place and r["_near"] < 0):
            break
        chosen.append((r[key], place))
        near = gap([r[c] for c in columns])
        # A chosen row falls below 0 and never comes again.
        least = near if not place else F.when(F.col("_near") >= 0, F.least("_near", near)).otherwise(F.col("_near"))
        rows = rows.withColumn("_near", F.when(F.col(key) == F.lit(r[key]), -1.0).otherwise(least))
        if place % every == every - 1:
            rows = cut_lineage(rows)
    return df.sparkSession.createDataFrame(chosen, f"`{key}` {df.schema[key].dataType.simpleString()}, place int")


def kennard_stone_folds(df: DataFrame, columns: Sequence[str], key: str, k: int, n: int, seed: int = 0) -> DataFrame:
    """``df`` with ``fold``: the ``n`` rows of the Kennard-Stone order are dealt in turn, so each fold spans the data; the others by hash."""
    order = kennard_stone(df, columns, key, n)
    return df.join(F.broadcast(order), key, "left").withColumn("fold", F.coalesce(F.col("place") % k, fold_of(k, seed, [key]))).drop("place")


def cross_validated_regression(folded: DataFrame, columns: Sequence[str], y: str, components: Sequence[int]) -> DataFrame:
    """(repeat, fold, k, r2) of PLS with each number of components: all fits from one pass of moments per fold.

    The moments of a training set are the whole's less the fold's; the held-out error needs
    only the fold's own moments as well, so no model is trained by a scan of its own.
    """
    from sparkchemo.operators.projection import kernel_pls

    p = len(columns)
    parts = grouped_moments(folded, [*columns, y], ["repeat", "fold"])
    rows = []
    for repeat in sorted({r for r, _ in parts}):
        own = {f: m for (r, f), m in parts.items() if r == repeat}
        whole = None
        for m in own.values():
            whole = m if whole is None else whole + m
        for fold, m in sorted(own.items()):
            train = whole - m
            for k in components:
                _, rot, _, inner = kernel_pls(train.products[:p, :p], train.products[:p, p : p + 1], k)
                b = rot @ inner[:, 0]
                gap = (m.mean[p] - train.mean[p]) - b @ (m.mean[:p] - train.mean[:p])
                sse = m.products[p, p] - 2 * b @ m.products[:p, p] + b @ m.products[:p, :p] @ b + m.n * gap**2
                rows.append((repeat, fold, k, float(1 - sse / m.products[p, p])))
    return folded.sparkSession.createDataFrame(rows, "repeat int, fold int, k int, r2 double")


def repeated_scores(folded: DataFrame, estimators: dict[str, Callable[[DataFrame, DataFrame], float]]) -> DataFrame:
    """(estimator, repeat, fold, score): each estimator is a function (train, test) -> score, on the same splits."""
    splits = [(r["repeat"], r["fold"]) for r in folded.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]
    rows = []
    for repeat, fold in splits:
        here = folded.where(F.col("repeat") == repeat)
        train, test = here.where(F.col("fold") != fold), here.where(F.col("fold") == fold)
        rows += [(name, repeat, fold, float(f(train, test))) for name, f in estimators.items()]
    return folded.sparkSession.createDataFrame(rows, "estimator string, repeat int, fold int, score double")


def paired_summary(scores: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_a, mean_b, mean_diff, var_diff) of two estimators' scores over the same splits; nulls are left out."""
    pick = lambda name, to: scores.where(F.col("estimator") == name).select("repeat", "fold", F.col("score").alias(to))
    both = pick(a, "x").join(pick(b, "y"), ["repeat", "fold"]).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(F.col("x") - F.col("y")).alias("mean_diff"), F.var_samp(F.col("x") - F.col("y")).alias("var_diff"))


def with_corrected_t(summary: DataFrame, repeats: int) -> DataFrame:
    """``summary`` with ``t`` of the test that a beats b, its variance corrected for shared training rows (Nadeau and Bengio)."""
    share = F.lit(float(repeats)) / F.col("n")  # of a split that is held out
    return summary.withColumn("t", F.try_divide(F.col("mean_diff"), F.sqrt((1 / F.col("n") + share / (1 - share)) * F.col("var_diff"))))


def corrected_t(summary: DataFrame, repeats: int) -> dict[str, float]:
    """t and p of the one-sided test that a, which must be the better one, beats b."""
    r = with_corrected_t(summary, repeats).first()
    if r["mean_diff"] < 0:
        raise ValueError("a must be the better one")
    t = math.inf if r["t"] is None else r["t"]
    return {"t": t, "p": 1 - t_cdf(t, r["n"] - 1) if math.isfinite(t) else 0.0}


def ranked(scores: DataFrame) -> DataFrame:
    """(estimator, n, mean, deviation, place): estimators by falling mean score; ties by name."""
    seen = F.when(~F.isnan("score"), F.col("score"))
    table = scores.groupBy("estimator").agg(F.count(seen).alias("n"), F.avg(seen).alias("mean"), F.stddev_pop(seen).alias("deviation"))
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "estimator")))  # a row an estimator


def bayesian_comparison(summary: DataFrame, repeats: int, rope: float = 0.0) -> dict[str, float]:
    """Probabilities that b is better, that they are alike within ``rope``, and that a is (correlated t posterior)."""
    r = summary.first()
    share = repeats / r["n"]
    scale = math.sqrt((1 / r["n"] + share / (1 - share)) * r["var_diff"])
    if not scale:
        d = r["mean_diff"]
        return {"left": float(d < -rope), "rope": float(abs(d) <= rope), "right": float(d > rope)}
    low, high = (t_cdf((x - r["mean_diff"]) / scale, r["n"] - 1) for x in (-rope, rope))
    return {"left": low, "rope": high - low, "right": 1 - high}
