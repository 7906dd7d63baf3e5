import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.operators import comparison, imputation, openset, rebalance, screens, spectra
from sparkchemo.operators.moments import grouped_moments, moments
from sparkchemo.operators.projection import PCA, PLSDA, SIMCA, Ellipse, LatentRegression, kernel_pls
from sparkchemo.operators.scaling import CorrectedScaler, RobustScaler

C = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    t = rng.normal(size=(120, 2))
    return t @ rng.normal(size=(2, 4)) + 0.2 * rng.normal(size=(120, 4)) + [1, -2, 30, 4]


@pytest.fixture(scope="module")
def df(spark, x):
    return spark.createDataFrame([(i, *map(float, r), "u" if i % 2 else "v") for i, r in enumerate(x)], "id bigint, a double, b double, c double, d double, cls string").repartition(3)


def columns(df, *names):
    return np.array([[r[n] for n in names] for r in df.orderBy("id").collect()], float)


def test_moments_match_numpy_and_subtract(df, x):
    m = moments(df, C)
    np.testing.assert_allclose(m.covariance, np.cov(x.T), rtol=1e-7)
    parts = grouped_moments(df, C, ["cls"])
    both = parts["u",] + parts["v",]
    np.testing.assert_allclose(both.products, m.products, rtol=1e-7)
    np.testing.assert_allclose((m - parts["u",]).covariance, np.cov(x[::2].T), rtol=1e-7)


def test_scalers(df, x):
    got = columns(CorrectedScaler(C).fit(df).transform(df), *C)
    np.testing.assert_allclose(got, (x - x.mean(0)) / x.std(0, ddof=1), rtol=1e-7)
    q = np.percentile(x, [25, 50, 75], axis=0)
    np.testing.assert_allclose(columns(RobustScaler(C).fit(df).transform(df), *C), (x - q[1]) / (q[2] - q[0]), rtol=1e-7)
    with pytest.raises(ValueError):
        CorrectedScaler(["k"]).fit(df.withColumn("k", F.lit(1.0)))


@pytest.mark.parametrize("scale", [False, True])
def test_pca_scores_and_limits(df, x, scale):
    model = PCA(C, 2, scale=scale, robust="classical").fit(df)
    z = (x - x.mean(0)) / (x.std(0, ddof=1) if scale else 1)
    value, vector = np.linalg.eigh(np.cov(z.T))
    axes = vector[:, ::-1][:, :2]
    t = z @ axes
    t *= np.sign(t[np.abs(t).argmax(0), range(2)])
    got = columns(model.transform(model.score(df)), "pc1", "pc2", "h", "q", "distance")
    np.testing.assert_allclose(got[:, :2], t, rtol=1e-7, atol=1e-9)
    h = (t**2 / value[::-1][:2]).sum(1)
    q = ((z - z @ axes @ axes.T) ** 2).sum(1)
    np.testing.assert_allclose(got[:, 2:4], np.stack([h, q], 1), rtol=1e-7, atol=1e-9)
    n = [max(round(2 * u.mean() ** 2 / u.var(ddof=1)), 1) for u in (h, q)]
    np.testing.assert_allclose(got[:, 4], n[0] * h / h.mean() + n[1] * q / q.mean(), rtol=1e-7)
    assert model.c_crit < model.c_out


def test_component_count_is_checked_or_capped(df):
    with pytest.raises(ValueError):
        PCA(C, 9).fit(df)
    assert PCA(C, 9, capped=True).fit(df).space.axes.shape[1] == 3


def test_cleaning_drops_planted_outliers(spark, x):
    bad = np.vstack([x, x[:3] + 60 * np.array([1, -1, 1, -1])])
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(bad)], "id bigint, a double, b double, c double, d double")
    model = PCA(C, 2, clean=True).fit(rows)
    assert model.n <= 121 and model.history
    assert {r["id"] for r in model.score(rows).where("outlier").collect()} >= {120, 121, 122}


def test_simca_distance(df, x):
    model = SIMCA(C, 1, scale=True).fit(df)
    s = x.std(0, ddof=1)
    z = (x - x.mean(0)) / s
    axis = np.linalg.eigh(np.cov(z.T))[1][:, -1:]
    od = (((z - z @ axis @ axis.T) * s) ** 2).sum(1)
    want = (od / 3) / (od.sum() / (3 * (120 - 2)))
    np.testing.assert_allclose(columns(model.score(df), "distance")[:, 0], want, rtol=1e-7)


def test_pls_equals_regression_with_all_components(df, x):
    y = x[:, 0] * 2 - x[:, 1] + 0.5
    rows = df.withColumn("y", 2 * F.col("a") - F.col("b") + 0.5)
    model = LatentRegression(C, "y", 4, robust=False).fit(rows)
    np.testing.assert_allclose(columns(model.score(rows), "predicted")[:, 0], y, rtol=1e-7)
    assert model.r2(rows, "y").first()["r2"] == pytest.approx(1)


def test_one_component_pls_matches_its_definition(df, x):
    rows = df.withColumn("y", F.sin("a") + F.col("c"))
    y = np.sin(x[:, 0]) + x[:, 2]
    z, yc = x - x.mean(0), y - y.mean()
    w = z.T @ yc
    t = z @ (w / np.linalg.norm(w))
    want = y.mean() + t * (t @ yc) / (t @ t)
    model = LatentRegression(C, "y", 1).fit(rows)
    np.testing.assert_allclose(columns(model.score(rows, "y"), "predicted")[:, 0], want, rtol=1e-8)


def test_kernel_pls_rotations_are_orthogonal_in_x(x):
    z = x - x.mean(0)
    _, r, _, _ = kernel_pls(z.T @ z, z.T @ np.stack([z[:, 0] ** 2, z[:, 3]], 1), 3)
    g = r.T @ z.T @ z @ r
    np.testing.assert_allclose(g - np.diag(np.diag(g)), 0, atol=1e-6)


def test_plsda_tells_classes_apart(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], *map(float, rng.normal(size=4) + 6 * np.eye(4)[i % 3])) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, cls string, a double, b double, c double, d double")
    for style in ("hard", "soft"):
        out = PLSDA(C, "cls", 2, style=style).fit(df).score(df).collect()
        assert np.mean([r["cls"] in r["predicted"] for r in out]) > 0.9
    assert all(sum(r[f"p_{k}"] for k in "abc") == pytest.approx(1) for r in PLSDA(C, "cls", 2, style="hard").fit(df).score(df).collect())
    with pytest.raises(ValueError):
        PLSDA(C, "cls", 1).fit(df.where("cls = 'a'"))


def test_ellipse_border_is_inside(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in (-1, 1) for b in (-1, 1)], "a double, b double")
    model = Ellipse(["a", "b"]).fit(df)
    assert model.d_crit == pytest.approx(-2 * math.log(0.05))
    assert model.score(df).where("inlier").count() == 4
    assert model.shape()[0][0] == pytest.approx(math.sqrt(model.d_crit * 4 / 3))


def test_snv_and_detrend(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([3.0, 4.0, 5.0],)], "x array<double>")
    got = df.select(spectra.snv(F.col("x")).alias("s"), spectra.snv(F.col("x"), robust=True, q=51).alias("r"), spectra.snv(F.col("x"), detrend=True, length=3).alias("d")).collect()
    for r in got:
        np.testing.assert_allclose(r["s"], [-1, 0, 1], atol=1e-12)
        np.testing.assert_allclose(r["r"], [-1.02, -0.02, 0.98], atol=1e-12)
        np.testing.assert_allclose(r["d"], 0, atol=1e-12)


@pytest.mark.parametrize("mode", ["interp", "mirror", "nearest", "wrap", "constant"])
def test_savgol_keeps_parabolas(spark, mode):
    x = [0.5 * i * i - 3 * i + 2 for i in range(12)]
    df = spark.createDataFrame([(x,)], "x array<double>")
    got = df.select(spectra.savgol(F.col("x"), 12, 5, 2, mode=mode).alias("y"), spectra.savgol(F.col("x"), 12, 5, 2, deriv=1, mode=mode).alias("d")).first()
    inner = slice(None) if mode == "interp" else slice(2, 10)
    np.testing.assert_allclose(got["y"][inner], x[inner], atol=1e-9)
    np.testing.assert_allclose(got["d"][inner], [i - 3 for i in range(12)][inner], atol=1e-9)


def test_divergence_of_a_known_table(spark):
    rows = [(1.0, 1.0, "A"), (2.0, 2.0, "A"), (3.0, 3.0, "A"), (0.0, 0.0, "B"), (4.0, 2.0, "B"), (5.0, 5.0, "B")]
    df = spark.createDataFrame(rows, "f double, g double, y string")
    got = {(r["feature"], r["cls"]): r["jsd"] for r in screens.js_per_class(df, ["f", "g"], "y").collect()}
    assert got["f", "A"] == pytest.approx(1.0, abs=1e-6) and got["g", "B"] == pytest.approx(2 / 3, abs=1e-6)
    more = df.union(spark.createDataFrame([(100.0, 100.0, "A")], df.schema))
    robust = {(r["feature"], r["cls"]): r["jsd"] for r in screens.js_per_class(more, ["f", "g"], "y", robust=True).collect()}
    assert robust["f", "A"] == pytest.approx(1.0, abs=1e-6) and robust["g", "A"] == pytest.approx(2 / 3, abs=1e-6)


def test_red_flags_find_planted_faults(spark):
    rows = [(1.0, 7.0, float("nan"), "A")] * 2 + [(2.0, 7.0, float("inf"), "A"), (3.0, 7.0, 1.0, "B")]
    df = spark.createDataFrame(rows, "p double, k double, n double, y string")
    got = {(r["check"], r["cls"], r["feature"]) for r in screens.red_flags(df, ["p", "k", "n"], "y").collect() if r["found"]}
    assert {("nan", None, "n"), ("inf", None, "n"), ("zero_variance", None, "k"), ("min_obs", "B", None), ("duplicates", None, None), ("zero_class_variance", "B", "p")} <= got
    assert ("nan", None, "p") not in got


def test_spearman_and_clusters(df, x):
    rank = lambda v: np.argsort(np.argsort(v))
    got = {(r["a"], r["b"]): r["rho"] for r in screens.spearman(df, C).collect()}
    for i, j in combinations(range(4), 2):
        assert got[C[i], C[j]] == pytest.approx(np.corrcoef(rank(x[:, i]), rank(x[:, j]))[0, 1])
    assert screens.ward_clusters([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]], 0.5) == [0, 0, 1]


def test_imputers(df, x):
    gaps = df.withColumn("b", F.when(F.col("id") % 7 != 0, F.col("b")))
    model = imputation.LowRankImputer(C, n_components=2, tol=1e-5).fit(gaps)
    got = columns(model.transform(gaps), "b")[:, 0]
    hole = np.arange(120) % 7 == 0
    assert np.abs(got[hole] - x[hole, 1]).mean() < np.abs(x[hole, 1] - x[~hole, 1].mean()).mean() / 2
    assert (got[~hole] == x[~hole, 1]).all()
    low = imputation.below_limit(gaps, {"b": 0.5}, ["id"])
    assert columns(low, "b").min() >= 0 and columns(low, "b").tolist() == columns(low.repartition(7), "b").tolist()


def test_rebalancing(spark):
    rows = [(i, float(i % 40), "big" if i < 30 else "small") for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, v double, y string")
    out = rebalance.smote(df, ["v"], "y", "id", k=3)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {"big": 30, "small": 30}
    made = [r["v"] for r in out.where("id is null").collect()]
    assert min(made) >= 30 and max(made) <= 39


def test_open_set_needs_two_classes(df):
    gate = lambda rows: lambda t: t.withColumn("inlier", F.col("cls") == "u")
    with pytest.raises(ValueError):
        openset.fit_open_set(df, "cls", ["u", "v"], gate, lambda rows: openset.nearest_centroid(rows, C, "cls"))


def test_threshold_takes_the_lower_rank(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert openset.fit_threshold(df, lambda: F.col("v"), 0.05).cut == 5.0
    assert openset.fit_threshold(df.where("v < 100"), lambda: F.col("v"), 0.05).cut == 4.0


def test_cross_validation_by_moments_equals_refitting(df, x):
    folded = comparison.repeated_folds(df.withColumn("y", F.col("a") + F.col("d")), ["id"], 3, 2)
    got = {(r["repeat"], r["fold"], r["k"]): r["r2"] for r in comparison.cross_validated_regression(folded, ["b", "c", "d"], "y", [1, 2]).collect()}
    rows = folded.where("repeat = 1")
    train, test = rows.where("fold <> 2"), rows.where("fold = 2")
    want = LatentRegression(["b", "c", "d"], "y", 2, robust=False).fit(train)
    r = test.select(F.col("y"), want.predict().alias("p")).collect()
    y, p = np.array([v["y"] for v in r]), np.array([v["p"] for v in r])
    assert got[1, 2, 2] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_paired_tests(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(1, 0.1, 20), rng.normal(0.9, 0.1, 20)
    s = spark.createDataFrame([(n, i // 4, i % 4, float(v[i])) for n, v in (("a", a), ("b", b)) for i in range(20)], "estimator string, repeat int, fold int, score double")
    summary = comparison.paired_summary(s, "a", "b")
    d = a - b
    t = d.mean() / math.sqrt((1 / 20 + 0.25 / 0.75) * d.var(ddof=1))
    assert comparison.corrected_t(summary, 5)["t"] == pytest.approx(t)
    p = comparison.bayesian_comparison(summary, 5, 0.01)
    assert sum(p.values()) == pytest.approx(1) and p["right"] > p["left"]
    with pytest.raises(ValueError):
        comparison.corrected_t(comparison.paired_summary(s, "b", "a"), 5)


def test_group_folds_are_even_and_kennard_stone_starts_far(spark, df):
    g = spark.createDataFrame([(k,) for k, n in (("a", 9), ("b", 5), ("c", 4), ("d", 3)) for _ in range(n)], "g string")
    got = {r["fold"]: 0 for r in comparison.group_folds(g, "g", 2).collect()}
    for r in comparison.group_folds(g, "g", 2).collect():
        got[r["fold"]] += r["n"]
    assert sorted(got.values()) == [9, 12]
    order = [r["id"] for r in comparison.kennard_stone(df, C, "id", 12).orderBy("place").collect()]
    assert len(set(order)) == 12 and set(order) < set(range(120))


def test_chi_squared_tails_and_extremes_by_inversion(spark):
    from sparkchemo.functions.expr import chi2_tail
    from sparkchemo.functions.special import chi2_ppf, gamma_p

    dofs, xs = [1, 2, 3, 4, 7, 30, 151], [0.0, 1e-6, 0.3, 2.0, 6.2, 12.4, 12.6, 40.0, 160.0, 900.0, 2000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[chi2_tail(F.col("x"), d).alias(f"d{d}") for d in dofs]).collect()
    for r in got:
        assert all(r[f"d{d}"] == pytest.approx(1 - gamma_p(d / 2, r["x"] / 2), abs=1e-13) for d in dofs)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 2, 3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    model, ellipse = PCA(["a", "b", "c"], 2).fit(df), Ellipse(["a", "b", "c"]).fit(df)
    for table, cut, scored in ((model.extremes(df), lambda k: model.critical(k / 400), model.score(df)), (ellipse.extremes(df, 400, 0.5), lambda k: chi2_ppf(1 - k / 400, 3) ** 0.5, ellipse.score(df))):
        d = np.array([r["distance"] for r in scored.select("distance").collect()])
        rows = table.orderBy("expected").collect()
        assert [r["expected"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) in (100, 200)
        assert [r["observed"] for r in rows] == [int((d > cut(k)).sum()) for k in range(1, len(rows) + 1)]


def test_plsda_distances_of_classes_that_hardly_differ():
    """Second moments about a far corner are all but singular: distances agree with exact arithmetic."""
    from fractions import Fraction

    from sparkchemo.operators.moments import Moments

    rng = np.random.default_rng(3)
    groups = {}
    for i, c in enumerate("abc"):
        x = rng.normal(size=(400, 3)) * [1, 5, 20]
        x += 1e-8 * rng.normal(size=3) - x.mean(0)
        groups[c,] = Moments(("x", "y", "z"), 400 + i, x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))
    model = PLSDA(["x", "y", "z"], "cls", 2).from_groups(groups)
    whole = groups["a",] + groups["b",] + groups["c",]
    exact = lambda a: np.array([[Fraction(float(v)) for v in row] for row in np.atleast_2d(a)], object)
    rows = rng.normal(size=(50, 3)) * [1, 5, 20]
    b, d = exact(model.coefficients), []
    for i, c in enumerate("abc"):
        part, center = groups[c,], exact(model.centers[i])
        off = (exact(part.mean) - exact(whole.mean)) @ b - center
        (p, q), (_, r) = b.T @ exact(part.products) @ b / part.n + off.T @ off
        g = (exact(rows) - exact(whole.mean)) @ b - center
        d.append([float(v) for v in (g[:, 0] ** 2 * r - 2 * g[:, 0] * g[:, 1] * q + g[:, 1] ** 2 * p) / (p * r - q * q)])
    order = np.array(list("abc"), object)[np.array(d).argmin(0)]
    assert (model.nearest(rows) == order).all()
    assert model.about_mean.keys() == {"a", "b", "c"}
    for i, c in enumerate("abc"):
        mean, white, way = model.about_mean[c]
        w = (rows - mean) @ white
        np.testing.assert_allclose((w * w).sum(1) + 1 - (1 - w @ way) ** 2 / (1 + way @ way), d[i], rtol=1e-7)


def test_nearest_half_equals_numpy(spark):
    from sparkchemo.operators.projection import EllipseModel, nearest_half

    for n in (401, 400):
        x = np.random.default_rng(n).normal(size=(n, 2)) * [1, 30]
        x[:60] = x[0]
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x double, y double").repartition(3)
        d = np.sqrt((x[:, 0] - 0.1) ** 2 + (x[:, 1] / 30) ** 2)
        for bins in (4096, 3):
            cut, m = nearest_half(df, EllipseModel(("x", "y"), np.array([0.1, 0.0]), np.diag([1.0, 900.0]), 0.05), bins)
            own = x[d <= np.median(d) + 1e-12]
            assert (cut, m.n) == (pytest.approx(np.median(d)), len(own))
            np.testing.assert_allclose(m.covariance, np.cov(own.T), atol=1e-9)
