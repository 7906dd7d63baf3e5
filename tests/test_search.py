"""Nested searches against a fit for each split, and the rule for nulls in moments."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.operators import search
from sparkchemo.operators.moments import WIDE, moments
from sparkchemo.operators.projection import PCA, PLSDA, SIMCA, Ellipse, LatentRegression


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4)) * [1, 5, 0.2, 2]
    y = x @ [1.0, 0.3, 2.0, 0.0] + rng.normal(size=240)
    cls = np.where(x[:, 0] + 0.2 * rng.normal(size=240) > 0.4, "a", np.where(x[:, 1] > 0, "b", "c"))
    data = [(i, *map(float, x[i]), float(y[i]), str(cls[i]), i % 2, (i // 2) % 2) for i in range(240)]
    return spark.createDataFrame(data, "id int, x0 double, x1 double, x2 double, x3 double, y double, cls string, outer int, inner int").coalesce(2).cache()


X = ["x0", "x1", "x2", "x3"]


def test_settings_are_grids_or_seeded_draws():
    space = {"k": [1, 2], "scale": [True, False]}
    assert search.grid(space) == [{"k": a, "scale": b} for a in (1, 2) for b in (True, False)]
    assert search.draw(space, 3, 5) == search.draw(space, 3, 5) and len({str(s) for s in search.draw(space, 99)}) == 4
    drawn = search.draw({"alpha": lambda rng: rng.uniform(0, 1), "k": [1]}, 6, 2)
    assert len(drawn) == 6 and all(0 <= s["alpha"] <= 1 for s in drawn)


def by_fitting(rows, model, settings, score):
    """Every split by its own fit and scan."""
    out = {}
    for o in range(2):
        train, test = rows.where(f"outer <> {o}"), rows.where(f"outer = {o}")
        for s, setting in enumerate(settings):
            own = type(model)(**{**model.__dict__, **setting})
            inner = [score(own.fit(train.where(f"inner <> {i}")), train.where(f"inner = {i}")) for i in range(2)]
            out[o, s] = (inner, score(own.fit(train), test))
    return out


def check(found, want, settings):
    found = {(r["outer"], r["setting"]): r for r in found.collect()}
    assert set(found) == set(want)
    for (o, s), (inner, outer) in want.items():
        r = found[o, s]
        assert np.allclose(r["scores"], inner, atol=1e-9) and abs(r["mean"] - np.mean(inner)) < 1e-9 and json.loads(r["params"]) == settings[s]
        best = max(range(len(settings)), key=lambda k: np.mean(want[o, k][0]))
        assert r["chosen"] == (s == best) and (r["outer_score"] is None) == (s != best)
        assert s != best or abs(r["outer_score"] - outer) < 1e-9


def test_regressions_equal_a_fit_for_each_split(rows):
    settings = [{"n_components": 1}, {"n_components": 2, "scale": True}, {"kind": "pcr", "n_components": 3, "scale": True}, {"columns": X[:2]}]
    model = LatentRegression(X, "y", 1, robust=False)
    found = search.nested_search(rows, model, settings)
    check(found, by_fitting(rows, model, settings, lambda m, t: m.r2(t, "y").first()[0]), settings)
    scores = search.validation_scores(found, "pls")
    assert scores.columns == ["estimator", "repeat", "fold", "score"] and scores.count() == 4


def test_classes_equal_a_fit_for_each_split(rows):
    settings = [{"scale": True}, {"scale": False, "n_components": 4}, {"columns": X[:3]}]
    model = PLSDA(X, "cls", 2, style="hard")

    def right(m, test):
        return m.score(test).agg(F.avg((F.col("predicted")[0] == F.col("cls")).cast("double"))).first()[0]

    check(search.nested_search(rows, model, settings), by_fitting(rows, model, settings, right), settings)


def test_settings_that_cannot_be_fitted_and_odd_folds(rows):
    found = search.nested_search(rows, LatentRegression(X, "y"), [{"n_components": 9}, {"n_components": 2}]).collect()
    assert all(r["chosen"] == (r["setting"] == 1) and (r["mean"] is None) == (r["setting"] == 0) for r in found)
    by_hash = search.nested_search(rows.drop("outer", "inner"), LatentRegression(X, "y"), [{}], 4, 3, ["id"]).collect()
    assert [len(r["scores"]) for r in by_hash] == [3] * 4
    with pytest.raises(ValueError):
        search.nested_search(rows.withColumn("outer", F.lit(0)), LatentRegression(X, "y"), [{}])


@pytest.mark.parametrize("width", [WIDE - 1, WIDE + 12])
def test_a_row_with_a_null_counts_nowhere(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(90, width))
    holes = {3: 0, 17: 5, 40: width - 1}
    data = [(i, *[None if holes.get(i) == k else float("nan") if (i, k) == (50, 2) else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)]
    names = [f"c{k}" for k in range(width)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    m, own = moments(df, names), np.delete(x, [*holes, 50], 0)
    assert m.n == 86 and np.allclose(m.mean, own.mean(0)) and np.allclose(m.covariance, np.cov(own.T))


def test_models_fit_on_the_rows_without_nulls(spark):
    rng = np.random.default_rng(2)
    names = ["c0", "c1", "c2", "c3"]
    data = [(i, *[None if (i, k) in {(3, 0), (9, 3)} else float(v) for k, v in enumerate(r)]) for i, r in enumerate(rng.normal(size=(60, 4)))]
    df = spark.createDataFrame(data, "id int, c0 double, c1 double, c2 double, c3 double").coalesce(2)
    for model in (PCA(names, 2), SIMCA(names, 2), LatentRegression(names[1:], names[0], 2), Ellipse(names[:3], robust=True)):
        used = [*model.columns, *([model.y] if isinstance(model, LatentRegression) else [])]
        one, two = (m.score(df).where("id = 1").first().asDict() for m in (model.fit(df), model.fit(df.dropna(subset=used))))
        assert all(one[k] == pytest.approx(two[k], rel=1e-9) for k in one if isinstance(one[k], float))
