"""SHAP values against their definition, by enumeration of all feature subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from sparkchemo.operators import attribution, screens

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(250, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float) + (x[:, 3] > 1)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, d double, y double").coalesce(2)
    return x, VectorAssembler(inputCols=X, outputCol="v").transform(df).cache()


def by_subsets(nodes, x, classes):
    """Shapley values of the conditional expectation that follows known features and averages over the others by cover."""
    value = lambda r: np.array(r["stats"]) / sum(r["stats"]) if classes else np.array([r["prediction"]])

    def mean(tree, r, known):
        if r["left"] < 0:
            return value(r)
        left, right = tree[r["left"]], tree[r["right"]]
        if r["feature"] in known:
            return mean(tree, left if x[r["feature"]] <= r["threshold"] else right, known)
        return (left["cover"] * mean(tree, left, known) + right["cover"] * mean(tree, right, known)) / r["cover"]

    def whole(known):
        return sum(mean(t, t[0], known) for t in nodes) / len(nodes)

    p, out = len(x), []
    for j in range(p):
        rest = [i for i in range(p) if i != j]
        parts = [(math.factorial(s) * math.factorial(p - s - 1) / math.factorial(p)) * (whole({*own, j}) - whole({*own})) for s in range(p) for own in itertools.combinations(rest, s)]
        out.append(sum(parts))
    return np.array(out), whole(set()), whole(set(range(p)))


@pytest.mark.parametrize("kind", ["classes", "regression"])
def test_values_equal_enumeration(spark, rows, kind):
    x, df = rows
    classes = kind == "classes"
    forest = (RandomForestClassifier if classes else RandomForestRegressor)(labelCol="y", featuresCol="v", numTrees=3, maxDepth=4, seed=2).fit(df)
    found = attribution.attribute(forest, spark, classes)
    trees: dict = {}
    for r in attribution.node_table(forest, spark).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    got = {(r["id"], r["output"]): r["values"] for r in attribution.shap_values(found, df.where("id < 12"), X, "id").collect()}
    for i in range(12):
        want, base, full = by_subsets(list(trees.values()), x[i], classes)
        own = np.array([got[i, c] for c in range(want.shape[1])]).T
        assert np.allclose(own, want) and np.allclose(base, found.expected) and np.allclose(own.sum(0) + found.expected, full)
    predicted = forest.transform(df.where("id < 12")).select("id", "probability" if classes else "prediction").collect()
    for r in predicted:
        sums = found.expected + [sum(got[r[0], c]) for c in range(len(found.expected))]
        assert np.allclose(sums, r[1].toArray() if classes else r[1])
    mean = {r["feature"]: r["importance"] for r in attribution.shap_importance(found, df, X).collect()}
    assert np.allclose([mean[c] for c in X], np.abs(found.values(x)).sum(2).mean(0))


def test_shadows_keep_values_and_change_their_places(spark, rows):
    _, df = rows
    out = screens.shadows(df.drop("v"), X, 5).collect()
    again = screens.shadows(df.drop("v"), X, 5).collect()
    assert sorted(out) == sorted(again) and len(out) == 250
    for c in X:
        assert sorted(r[c] for r in out) == sorted(r[f"s_{c}"] for r in out) and sum(r[c] == r[f"s_{c}"] for r in out) < 60


def test_boruta_percentiles_and_importances(rows):
    _, df = rows
    for kind, percentile in (("shap", 100), ("impurity", 100), ("shap", 0)):
        got = {r["feature"]: r["hits"] for r in screens.boruta(df, ["a", "d"], "y", trials=2, trees=5, depth=3, percentile=percentile, importance=kind).collect()}
        assert got["a"] == 2
    with pytest.raises(ValueError):
        screens.boruta(df, X, "y", importance="gain")


def test_tables_by_tree_equal_those_by_leaf(spark, rows, monkeypatch):
    x, df = rows
    found = attribution.attribute(RandomForestClassifier(labelCol="y", featuresCol="v", numTrees=3, maxDepth=4, seed=2).fit(df), spark)
    one = found.values(x)
    by_leaves, visited = attribution._by_leaves, []
    monkeypatch.setattr(attribution, "_by_leaves", lambda leaves, rows, out: (visited.append(len(leaves) * len(rows)), by_leaves(leaves, rows, out))[1])
    found.values(np.tile(x, (1000, 1)))
    # Leaves are visited for the tables, not for the rows.
    assert sum(visited) < 1000 * len(x)
    monkeypatch.setattr(attribution, "MOST", 0)
    np.testing.assert_allclose(one, found.values(x), atol=1e-14)


def test_boruta_mixes_once_a_trial(spark, rows, monkeypatch):
    _, df = rows
    kept, values = [], screens.shap_importance
    monkeypatch.setattr(screens, "shap_importance", lambda found, mixed, columns: (kept.append(mixed.is_cached), values(found, mixed, columns))[1])
    screens.boruta(df.select(*X, "y"), X, "y", trials=2, trees=2, depth=2)
    assert kept == [True, True]
