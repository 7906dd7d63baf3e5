"""The minimum covariance determinant against plain concentration from every start, and planted outliers."""

import itertools

import numpy as np
import pytest

from sparkchemo.operators import mcd
from sparkchemo.operators.projection import Ellipse


def frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"c{k} double" for k in range(x.shape[1]))).coalesce(2)


def test_a_planted_cluster_is_left_out_that_holds_the_median_start(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(300, 5)), rng.normal(size=(200, 5)) + [12, 0, 0, 0, 0]  # 40 %
    df = frame(spark, np.concatenate([good, bad]))
    names = [f"c{k}" for k in range(5)]
    inside = {m: {r["id"]: r["inlier"] for r in Ellipse(names, robust=m).fit(df).score(df).select("id", "inlier").collect()} for m in (True, "mcd")}
    assert not any(inside["mcd"][i] for i in range(300, 500)) and sum(inside["mcd"][i] for i in range(300)) > 270
    assert any(inside[True][i] for i in range(300, 500))


def test_the_raw_half_has_the_least_determinant_of_all(spark):
    """Of all subsets of the size of the half, by enumeration."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(5, 2)) * 0.5 + 4])
    df = frame(spark, x)
    h = mcd.half(len(x), 2, None)
    least = min(itertools.combinations(range(len(x)), h), key=lambda s: np.linalg.det(np.cov(x[list(s)].T, bias=True)))
    own = x[list(least)]
    raw, final = mcd.minimum_covariance(df, ["c0", "c1"])
    ratio = raw.covariance / np.cov(own.T, bias=True)
    assert np.allclose(raw.location, own.mean(0)) and np.allclose(ratio, ratio[0, 0])
    d = np.einsum("ij,jk,ik->i", x - raw.location, np.linalg.inv(raw.covariance), x - raw.location)
    assert np.median(d) == pytest.approx(mcd.chi2_ppf(0.5, 2))
    kept = x[d < mcd.chi2_ppf(0.975, 2)]
    assert np.allclose(final.location, kept.mean(0)) and np.allclose(final.covariance, np.cov(kept.T, bias=True))


def test_starts_on_a_sample_lead_to_the_same_shape(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(150, 2)) + [9, -7]]))
    few, all_ = (mcd.minimum_covariance(df, ["c0", "c1"], sample=n)[0] for n in (120, 2000))
    assert np.allclose(few.location, all_.location, atol=0.05) and few.size == pytest.approx(all_.size, rel=0.05)


def test_given_centers_nulls_and_too_few_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 1)) + 2
    df = frame(spark, x)
    _, final = mcd.minimum_covariance(df, ["c0"], center=[0.0])
    assert final.location.tolist() == [0.0] and final.covariance[0, 0] > 3
    holes = df.union(df.limit(5).selectExpr("id", "cast(null as double)"))
    one, two = (mcd.minimum_covariance(t, ["c0"])[1] for t in (df, holes))
    assert np.allclose(one.covariance, two.covariance)
    with pytest.raises(ValueError):
        mcd.minimum_covariance(df.limit(2), ["c0"])
