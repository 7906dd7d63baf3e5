"""Operators that avoid sorting, buffers and driver loops, against plain numpy."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.functions.quantiles import order_statistics, quantiles
from sparkchemo.operators import comparison, explain, moments, rebalance, screens
from sparkchemo.operators.projection import PCA
from sparkchemo.sources import tables


@pytest.mark.parametrize("few", [4, 2048])
def test_quantiles_by_narrowing(spark, few):
    rng = np.random.default_rng(0)
    columns = {"a": rng.normal(size=500), "b": rng.integers(0, 3, 500).astype(float), "c": 10.0 ** rng.uniform(-300, 300, 500) * rng.choice([-1, 1], 500)}
    columns["c"][:3] = [np.inf, -np.inf, np.inf]
    columns["d"] = np.full(500, 7.0)
    df = spark.createDataFrame([tuple(float(v[k]) for v in columns.values()) for k in range(500)] + [(None, float("nan"), None, None)], "a double, b double, c double, d double")
    ranks = {0, 1, 249, 250, 499}
    got = order_statistics(df, {c: F.col(c) for c in columns}, lambda n: ranks, bins=8, few=few)
    for c, v in columns.items():
        assert got[c] == (500, {k: np.sort(v)[k] for k in ranks})
    q = quantiles(df, {"a": F.col("a")}, [0.1, 0.5, 0.77])["a"]
    assert q == pytest.approx(np.quantile(columns["a"], [0.1, 0.5, 0.77]).tolist(), rel=1e-12)
    assert quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}


def test_moments_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) + 100
    df = spark.createDataFrame([(f"g{k % 3}", *map(float, r)) for k, r in enumerate(x)], "g string, " + ", ".join(f"x{i} double" for i in range(6))).repartition(5)
    names = [f"x{i}" for i in range(6)]
    want = moments.grouped_moments(df, names, ["g"])
    monkeypatch.setattr(moments, "WIDE", 3)
    got = moments.grouped_moments(df, names, ["g"])
    assert set(got) == set(want)
    for g, m in want.items():
        assert got[g].n == m.n
        np.testing.assert_allclose(got[g].mean, m.mean)
        np.testing.assert_allclose(got[g].products, m.products, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(moments.moments(df, names).covariance, np.cov(x.T), rtol=1e-9)


def test_cleaning_keeps_no_history_between_fits(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(80, 3))], "a double, b double, c double")
    model = PCA(["a", "b", "c"], 1, clean=True)
    assert model.fit(df).history == model.fit(df).history


def test_npy_round_trip_and_file_order(spark, tmp_path):
    rows = [("d/x_10.npy", [2, 3], [float(k) for k in range(6)]), ("d/x_9.npy", [0], []), ("d/x_2.npy", [1, 1, 2], [0.5, -1.0])]
    df = spark.createDataFrame(rows, "path string, shape array<int>, data array<double>")
    back = tables.unpack_npy(tables.pack_npy(df)).withColumn("k", tables.file_number(F.col("path"))).orderBy("k").collect()
    assert [(r["path"], r["shape"], r["data"]) for r in back] == [rows[2], rows[1], rows[0]]
    tables.write_npy(df, str(tmp_path / "npy"), "float32")
    assert tables.unpack_npy(spark.read.parquet(str(tmp_path / "npy"))).count() == 3
    x, y = tables.split_label(spark.createDataFrame([(1, 0.5, "a")], "id int, c0 double, y string"), "y", {"c0": "1460.8"}, ["id"])
    assert x.columns == ["id", "1460.8"] and y.columns == ["id", "y"]
    several = spark.createDataFrame([(1, 0.5, "a", 2.0)], "id int, c0 double, y string, z double")
    x, y = tables.split_label(several, ["y", "z"], keys=["id"])
    assert x.columns == ["id", "c0"] and y.columns == ["id", "y", "z"]


def test_turns_equal_a_choice_for_each_group():
    """The closed form against one choice after the other, of equal groups from any loads."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        load, size, m = rng.integers(0, 40, int(rng.integers(1, 6))).tolist(), int(rng.integers(0, 9)), int(rng.integers(1, 60))
        loads, want = list(load), []
        for _ in range(m):
            f = min(range(len(loads)), key=lambda i: (loads[i], i))
            loads[f] += size
            want.append(f)
        runs = comparison._even_runs(load, size, m)
        assert [turn[(p - a) % len(turn)] for a, b, turn in runs for p in range(a, b)] == want and load == loads
    # Groups that take turns for ever give as few runs, whatever their number.
    assert len(comparison._even_runs([0, 7, 10**9], 3, 10**12)) <= 6
    load = np.zeros((3, 2))
    many = comparison._stratified_runs(load, np.array([2.0, 1.0]), np.array([9e12, 9e12]), 10**12)
    assert len(many) <= 6 and np.ptp(load[:, 0]) <= 2 and load.sum() == 3 * 10**12


def test_group_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{g:02d}", "ab"[int(rng.random() < (0.9 if g % 2 else 0.1))]) for g in range(40) for _ in range(int(rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "g string, y string").coalesce(2)
    size = Counter(g for g, _ in rows)
    load, want = [0] * 4, {}
    for g, n in sorted(size.items(), key=lambda x: (-x[1], x[0])):
        want[g] = load.index(min(load))
        load[want[g]] += n
    for kinds in (comparison.KINDS, 5):
        for table in (comparison.group_folds(df, "g", 4), comparison.group_folds(df, "g", 4, seed=1), comparison.stratified_group_folds(df, "g", "y", 4, kinds=kinds)):
            got = {r["g"]: (r["n"], r["fold"]) for r in table.collect()}
            assert {g: n for g, (n, _) in got.items()} == size and {f for _, f in got.values()} == set(range(4))
        share = defaultdict(Counter)
        for g, y in rows:
            share[got[g][1]][y] += 1
        whole = Counter(y for _, y in rows)
        assert all(abs(c["a"] / c.total() - whole["a"] / whole.total()) < (0.1 if kinds > 5 else 0.2) for c in share.values())
    assert {r["g"]: r["fold"] for r in comparison.group_folds(df, "g", 4).collect()} == want


def test_many_groups_are_placed_evenly(spark):
    """Far more groups than any list on the driver was long, a third of the rows in one, most of one row, a null group."""
    df = spark.range(60000).select(F.when(F.col("id") < 20000, "hot").when(F.col("id") % 20 == 0, F.concat(F.lit("p"), F.col("id") % 1000)).when(F.col("id") != 59999, F.col("id").cast("string")).alias("g"), (F.col("id") % 3 == 0).alias("y"))
    for table in (comparison.group_folds(df, "g", 4), comparison.stratified_group_folds(df, "g", "y", 4)):
        n = {r["fold"]: (r["n"], r["groups"]) for r in table.groupBy("fold").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")).collect()}
        assert sum(a for a, _ in n.values()) == 60000 and sum(b for _, b in n.values()) == df.select("g").distinct().count()
        rest = sorted(a for a, _ in n.values())
        assert rest[3] == 20000 and rest[2] - rest[0] <= 800  # the hot group alone; the others level within a group of 800


def test_kennard_stone(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    order = [int((z**2).sum(1).argmax())]
    while len(order) < 20:
        near = np.min([((z - z[k]) ** 2).sum(1) for k in order], axis=0)
        near[order] = -1
        order.append(int(near.argmax()))
    got = {r["place"]: r["id"] for r in comparison.kennard_stone(df, ["a", "b"], "id", 20, every=7).collect()}
    assert [got[k] for k in range(20)] == order
    assert comparison.kennard_stone(df.limit(3), ["a", "b"], "id", 9).count() == 3
    folds = {r["id"]: r["fold"] for r in comparison.kennard_stone_folds(df, ["a", "b"], "id", 4, 20).collect()}
    assert len(folds) == 60 and [folds[k] for k in order] == [k % 4 for k in range(20)]


def test_scaled_smote_enn(spark):
    rng = np.random.default_rng(5)
    rows = [(k, "a", float(rng.normal()), float(1000 * rng.normal())) for k in range(40)] + [(100 + k, "b", float(6 + rng.normal()), float(6000 + 1000 * rng.normal())) for k in range(12)]
    df = spark.createDataFrame(rows, "id int, y string, u double, v double")
    out = rebalance.scaled_smote_enn(df, ["u", "v"], "y", "id").collect()
    by = defaultdict(list)
    for r in out:
        by[r["y"]].append(r)
    assert len(by["b"]) > 30 and len(by["a"]) > 35 and len({r["id"] for r in out}) == len(out)
    known = {str(k): (u, v) for k, _, u, v in rows}
    assert all(known[r["id"]] == pytest.approx((r["u"], r["v"])) for r in out if not r["id"].startswith("made-"))
    made = [r for r in out if r["id"].startswith("made-")]
    u, v = (np.array([r[i] for r in rows if r[1] == "b"]) for i in (2, 3))
    assert made and all(r["y"] == "b" and u.min() <= r["u"] <= u.max() and v.min() <= r["v"] <= v.max() for r in made)


def test_label_entropy_of_clusters(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 1.0, 1.0)] * 20, "m1 double, m2 double, o1 double, o2 double, o3 double")
    labels = {"m1": "metal", "m2": "metal", "o1": "organic", "o2": "organic", "o3": "organic"}
    assert screens.least_label_entropy(df, {0: ["m1", "o2"], 1: ["m2", "o1"], 2: ["o3", "m2"]}, labels) == ["m1", "m2", "m2"]
    with pytest.raises(ValueError):
        screens.least_label_entropy(df, {0: ["o1"]}, labels)


def test_close_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 3, size=(200, 2))
    x[50] = x[10]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id int, a double, b double")
    got = {(r["a"], r["b"]) for r in screens.close_pairs(df, ["a", "b"], "id", 0.1).collect()}
    own = [k for k in range(200) if k != 50]
    assert got == {(i, j) for i in own for j in own if i < j and math.dist(x[i], x[j]) < 0.1} and got


def test_colors_by_nearest_place_and_bounds(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0, 7.0, 8.0, 9.0], [0.0, 1.0, 4.0])], "id int, s array<double>, m array<double>")
    rows = explain.color_table(df, "id", F.col("s"), F.col("m"), 5, interpolate=False, bounds=(0, 8)).orderBy("i").collect()
    assert [r["color"] for r in rows] == [0.0, 0.125, 0.125, 0.5, 0.5] and [r["value"] for r in rows] == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_boruta_takes_what_tells_the_classes(spark):
    rng = np.random.default_rng(7)
    rows = [("ab"[k % 2], float(k % 2 + 0.3 * rng.normal()), float(rng.normal()), float(rng.normal())) for k in range(120)]
    df = spark.createDataFrame(rows, "y string, good double, n1 double, n2 double")
    moved = screens.shadows(df, ["good", "n1"], 3)
    assert sorted(r["s_good"] for r in moved.collect()) == sorted(r[1] for r in rows) and moved.where("s_good = good").count() == 0
    got = {r["feature"]: r["status"] for r in screens.boruta(df, ["good", "n1", "n2"], "y", trials=7, trees=12).collect()}
    assert got["good"] == "accepted" and "accepted" not in (got["n1"], got["n2"])


def test_patterns_of_gaps_shuffle_no_rows(spark):
    from sparkchemo.operators.imputation import LowRankImputer

    z = spark.range(100).selectExpr("if(id % 2 = 0, '01', '10') AS _pattern", "id * 1.0D AS x", "id * 2.0D AS y")
    turn = {k: (np.ones((1, 2)), np.zeros(1)) for k in ("01", "10")}
    joined = LowRankImputer._with_turns(z, ["x", "y"], turn)
    assert "hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    assert LowRankImputer._largest(z, ["x", "y"], turn) == 297.0
