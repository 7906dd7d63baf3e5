"""Nested searches for a model's settings: a grid or random draws inside, an outer loop around.

The outer and the inner fold of a row are two columns, so the table falls into few cells. Linear
models need moments only, and moments add up: the training set of any inner fold of any
outer fold is the whole less some cells, so one scan gives the cells' moments and all models
for all candidates are fitted from these, with no scan of their own. A regression's held-out error
follows from moments as well; classes are predicted for all models in one more scan.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.operators.comparison import fold_of
from sparkchemo.operators.moments import Moments, grouped_moments
from sparkchemo.operators.projection import PLSDA, DiscriminantModel, LatentRegression

#: Parts of the scores' table: outer fold, inner fold (null: the outer fold itself), setting, score.
Scores = list[tuple[int, int | None, int, float | None]]


def grid(space: dict[str, Sequence]) -> list[dict]:
    """Every combination of the listed values, the last name changing fastest."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def draw(space: dict[str, Sequence | Callable[[random.Random], object]], n: int, seed: int = 0) -> list[dict]:
    """``n`` different settings at random, the same for a seed: a listed value, or what a function of the generator gives.

    Fewer if the space, being all lists, does not hold so many.
    """
    rng, found = random.Random(seed), []
    most = reduce(lambda a, v: a * (len(v) if not callable(v) else n), space.values(), 1)
    while len(found) < min(n, most):
        one = {k: v(rng) if callable(v) else rng.choice(list(v)) for k, v in space.items()}
        if one not in found:
            found.append(one)
    return found


def nested_folds(df: DataFrame, keys: Sequence[str], k_outer: int = 10, k_inner: int = 10, seed: int = 0) -> DataFrame:
    """``df`` with the folds ``outer`` and ``inner`` of each row by hashes of its keys."""
    return df.withColumns({"outer": fold_of(k_outer, seed, keys), "inner": fold_of(k_inner, seed + 1, keys)})


def _sum(parts: list[Moments]) -> Moments | None:
    return reduce(lambda a, b: a + b, parts) if parts else None


def _splits(cells: dict[tuple[int, int], Moments]) -> Iterator[tuple[int, int | None, Moments, Moments]]:
    """(outer, inner, training moments, held-out moments) of all inner folds, and with inner None of the outer ones."""
    whole = _sum(list(cells.values()))
    for o in sorted({o for o, _ in cells}):
        out = _sum([m for (p, _), m in cells.items() if p == o])
        if out.n == whole.n:
            raise ValueError("the rows have one outer fold")
        train = whole - out
        yield o, None, train, out
        for i in sorted({i for _, i in cells}):
            held = _sum([m for (p, j), m in cells.items() if p != o and j == i])
            if held is not None and held.n < train.n:
                yield o, i, train - held, held


def held_out_r2(model: LatentRegression, train: Moments, test: Moments) -> float | None:
    """R2 on the rows behind ``test`` of the regression fitted on those behind ``train``; the last column is y."""
    p = len(train.columns) - 1
    if not 1 <= model.n_components <= min(train.n - 1, p) or not test.products[p, p]:
        return None
    slope, intercept = model.coefficients(train)
    miss = test.mean[p] - intercept - slope @ test.mean[:p]
    sse = test.products[p, p] - 2 * slope @ test.products[:p, p] + slope @ test.products[:p, :p] @ slope + test.n * miss**2
    return float(1 - sse / test.products[p, p])


def _regression_scores(df: DataFrame, model: LatentRegression, settings: list[dict]) -> Scores:
    cells = grouped_moments(df, [*model.columns, model.y], ["outer", "inner"])
    found: Scores = []
    for o, i, train, held in _splits(cells):
        for s, setting in enumerate(settings):
            own = replace(model, **setting)
            names = [*own.columns, model.y]
            found.append((o, i, s, held_out_r2(own, train.of(names), held.of(names))))
    return found


def _class_scores(df: DataFrame, model: PLSDA, settings: list[dict]) -> Scores:
    """The share of rows whose nearest class is their own, for every split and setting in one scan after that of the moments."""
    rows = df.where(F.col(model.label).isNotNull())
    cells = grouped_moments(rows, model.columns, ["outer", "inner", model.label])
    classes = sorted({c for *_, c in cells})
    fitted: list[tuple[int, int | None, int, DiscriminantModel]] = []
    split = {c: {(o, i): (t, h) for o, i, t, h in _splits({(o, i): m for (o, i, k), m in cells.items() if k == c})} for c in classes}
    for o, i in sorted({k for own in split.values() for k in own}, key=lambda k: (k[0], -1 if k[1] is None else k[1])):
        for s, setting in enumerate(settings):
            own = replace(model, style="hard", **setting)
            train = {(c,): split[c][o, i][0].of(own.columns) for c in classes if (o, i) in split[c]}
            if len(train) == len(classes) and 1 <= own.n_components <= len(own.columns):
                fitted.append((o, i, s, own.from_groups(train)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(len(fitted), np.int64), np.zeros(len(fitted), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cls = np.array(batch.column("y").to_pylist(), object)
            outer, inner = (batch.column(c).to_numpy() for c in ("outer", "inner"))
            for k, (o, i, _, m) in enumerate(fitted):
                at = outer == o if i is None else (outer != o) & (inner == i)
                right[k] += int((m.nearest(x[at][:, [model.columns.index(c) for c in m.columns]]) == cls[at]).sum())
                seen[k] += int(at.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fitted))), pa.array(right), pa.array(seen)], ["k", "hits", "n"])

    asked = rows.dropna(subset=list(model.columns)).select(F.array(*[F.col(c).cast("double") for c in model.columns]).alias("x"), F.col(model.label).alias("y"), F.col("outer").cast("int").alias("outer"), F.col("inner").cast("int").alias("inner"))
    counts = asked.mapInArrow(task, "k bigint, hits bigint, n bigint").groupBy("k").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()  # a row a model
    return [(*fitted[r["k"]][:3], r["hits"] / r["n"] if r["n"] else None) for r in sorted(counts, key=lambda r: r["k"])]


def nested_search(df: DataFrame, model: LatentRegression | PLSDA, settings: list[dict], k_outer: int | None = None, k_inner: int = 10, keys: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """(outer, setting, params, scores, mean, chosen, outer_score): every setting in every outer fold.

    ``df`` has folds ``outer`` and ``inner``, or ``k_outer`` is given and they follow from ``keys``. ``settings`` (from ``grid`` or
    ``draw``) replace fields of ``model``: columns (of the model's own), n_components, scale, kind. ``scores`` are the inner
    validation folds' in order, R2 of a regression and the share of right classes of PLS-DA; ``chosen`` is the
    setting with the greatest mean in its outer fold, the first among equals, and only it has ``outer_score``: fitted on
    all of the outer training rows and scored on the outer fold. Rows with a null in a column of the model take no
    part. A setting that cannot be fitted has null scores and is not chosen.
    """
    if k_outer is not None:
        df = nested_folds(df, keys, k_outer, k_inner, seed)
    found = (_regression_scores if isinstance(model, LatentRegression) else _class_scores)(df, model, settings)
    inner: dict[tuple[int, int], list] = {}
    outer = {(o, s): v for o, i, s, v in found if i is None}
    for o, i, s, v in found:
        if i is not None:
            inner.setdefault((o, s), []).append(v)
    mean = {k: float(np.mean(v)) for k, v in inner.items() if all(x is not None and np.isfinite(x) for x in v)}
    best = {o: min(((-mean[p, s], s) for p, s in mean if p == o), default=(0, None))[1] for o, _ in outer}
    rows = [(o, s, json.dumps(settings[s], sort_keys=True), inner.get((o, s)), mean.get((o, s)), s == best[o], outer[o, s] if s == best[o] else None) for o, s in sorted(outer)]
    return df.sparkSession.createDataFrame(rows, "outer int, setting int, params string, scores array<double>, mean double, chosen boolean, outer_score double")


def validation_scores(found: DataFrame, estimator: str) -> DataFrame:
    """(estimator, repeat, fold, score) of the chosen settings' inner folds, an outer fold being a repeat: what paired tests compare.

    These scores chose the setting, so they are too good by a little, alike for all estimators on the same folds.
    """
    return found.where("chosen").select(F.lit(estimator).alias("estimator"), F.col("outer").alias("repeat"), F.posexplode("scores").alias("fold", "score"))
