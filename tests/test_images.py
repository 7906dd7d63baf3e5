"""Maps in two dimensions and the composed image table against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.operators import explain, spectra


def resized(x, rows, columns):
    """Separable triangle weights about the pixels' centres, as image libraries stretch and shrink."""

    def weights(size, n):
        out = np.zeros((n, size))
        for i in range(n):
            center, reach = (i + 0.5) * size / n, max(1.0, size / n)
            out[i] = np.maximum(0, 1 - np.abs(np.arange(size) + 0.5 - center) / reach)
        return out / out.sum(1, keepdims=True)

    return weights(x.shape[0], rows) @ x @ weights(x.shape[1], columns).T


@pytest.mark.parametrize("shape", [(9, 9), (4, 11), (2, 2), (1, 7), (3, 5)])
def test_resize_equals_numpy(spark, shape):
    rng = np.random.default_rng(1)
    images = [rng.normal(size=s) for s in ((3, 5), (6, 6), (1, 1))]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(images)], "id int, x array<array<double>>").coalesce(1)
    got = {r["id"]: r["y"] for r in df.select("id", explain.resize_image(F.col("x"), *shape).alias("y")).collect()}
    for k, x in enumerate(images):
        assert np.allclose(got[k], resized(x, *shape))
        if x.shape == shape:
            assert np.allclose(got[k], x)


def test_maps_average_before_they_rectify(spark):
    rng = np.random.default_rng(2)
    a, g = rng.normal(size=(3, 3, 2)), rng.normal(size=(3, 3, 2))
    kinds = "a array<array<array<double>>>, g array<array<array<double>>>"
    df = spark.createDataFrame([(a.tolist(), g.tolist()), (a.tolist(), (0 * g).tolist())], kinds)
    for elementwise, symmetric in ((True, True), (True, False), (False, True)):
        raw = (a * g).sum(2) if elementwise else a @ g.mean((0, 1))
        raw = (raw + raw.T) / 2 if symmetric else raw
        up = np.maximum(raw, 0)
        one, none = (r[0] for r in df.select(explain.activation_map_2d(F.col("a"), F.col("g"), elementwise, symmetric)).collect())
        assert np.allclose(one, up / up.max()) and all(v is None for row in none for v in row)
    m = np.round(rng.random((3, 4)), 3)
    row = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>").select(explain.condense(F.col("m")), explain.condense(F.col("m"), "max")).first()
    assert np.allclose(row[0], m.mean(0)) and np.allclose(row[1], m.max(0))
    with pytest.raises(ValueError):
        explain.condense(F.col("m"), "median")


def test_image_table_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(41, 12))) * (rng.random((41, 12)) > 0.2)
    rows = [(i, x[i].tolist(), "abc"[i % 3]) for i in range(41)] + [(50, [0.0] * 12, "a"), (51, None, "a"), (52, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, cls string").repartition(3)
    out = spectra.image_table(df, "id", "x", "cls", 2, 10, 0.3, exclude=["b"], difference=True).collect()
    assert {r["id"] for r in out} == {i for i in range(41) if i % 3 != 1} | {50} and {(r["cls"], r["code"]) for r in out} == {("a", 0), ("c", 1)}
    for c, n in (("a", 15), ("c", 13)):
        assert sum(r["cls"] == c for r in out) == n and sum(r["cls"] == c and r["split"] == "test" for r in out) == -(-n * 3 // 10)
    for r in out:
        if r["id"] == 50:
            assert r["image"] is None
            continue
        y = x[r["id"], 2:10]
        y = np.log(np.maximum(y / y.sum(), 1e-7))
        c = (2 * y - y.min() - y.max()) / (y.max() - y.min())
        s = np.sqrt(np.maximum(0, 1 - c * c))
        assert np.allclose(r["spectrum"], y) and np.allclose(r["image"], np.outer(s, c) - np.outer(c, s), atol=1e-7)
    whole = spectra.image_table(df, "id", "x", "cls", renormalise=False).collect()
    assert {r["split"] for r in whole} == {"train"} and all(len(r["spectrum"]) == 12 for r in whole)
    with pytest.raises(ValueError):
        spectra.image_table(df, "id", "x", "cls", 5, 5)


def test_a_map_works_out_its_arrays_once(spark):
    for made in (explain.activation_map(F.col("act"), F.col("grad")), explain.activation_map(F.col("act"), F.col("grad"), True), explain.activation_map_2d(F.col("act"), F.col("grad"))):
        text = made._jc.toString()
        assert (text.count("act"), text.count("grad")) == (1, 1)
