"""Coded forests against counting by hand, and what Boruta takes from them."""

import numpy as np
import pytest

from sparkchemo.operators import attribution, forest, screens

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = np.stack([np.round(rng.normal(size=3000), 3), rng.integers(0, 7, 3000) / 2, rng.integers(0, 40, 3000) - 20.0], 1)
    y = (x[:, 0] + x[:, 1] > 1).astype(int) + (x[:, 2] > 15)
    return x, y, spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(3)


@pytest.fixture(scope="module")
def blocks(table):
    patch = pytest.MonkeyPatch()
    patch.setattr(forest, "BLOCK", 700)
    coded = forest.code(table[2], X, "y", 3)
    patch.undo()
    return coded, forest.mixed(coded, 4, 3).persist()


def unpacked(blocks):
    """Codes [row, column], classes and bags [tree, row] of all blocks."""
    parts = [(np.frombuffer(r["_codes"], np.uint8).reshape(-1, r["_n"]), np.frombuffer(r["_class"], np.uint16), np.frombuffer(r["_bag"], np.uint8).reshape(-1, r["_n"])) for r in blocks.collect()]
    return np.concatenate([p[0] for p in parts], 1).T, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts], 1)


def test_codes_keep_the_rows_and_shadows_the_values(table, blocks):
    x, y, df = table
    coded, mixed = blocks
    codes, kind, bag = unpacked(mixed)
    n, cuts = forest.find_cuts(df, X)
    assert n == len(x) == len(codes) and len(coded.starts) > 1
    assert cuts[1].tolist() == [0, 0.5, 1, 1.5, 2, 2.5] and len(cuts[0]) == len(cuts[2]) == 31
    want = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)] + [y], 1)
    assert sorted(map(tuple, np.column_stack([codes[:, :3], kind]))) == sorted(map(tuple, want))
    assert np.bincount(codes[:, 0]).min() > 60  # a thirty-second of the rows in each interval, about
    for j in range(3):
        assert np.bincount(codes[:, j]).tolist() == np.bincount(codes[:, 3 + j]).tolist()
        assert abs(np.corrcoef(codes[:, j], codes[:, 3 + j])[0, 1]) < 0.1 and abs(np.corrcoef(kind, codes[:, 3 + j])[0, 1]) < 0.1
    share = np.bincount(bag.ravel(), minlength=4)[:4] / bag.size
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.02)
    again = unpacked(forest.mixed(coded, 4, 3))
    assert all((a == b).all() for a, b in zip(again, (codes, kind, bag), strict=True))


def test_values_dealt_to_blocks_at_random_sum_to_all():
    starts, counts = np.array([0, 100, 250, 251, 700]), np.array([300, 0, 390, 10])
    parts = [forest._share(counts, starts, b, [1, 2]) for b in range(4)]
    assert sum(parts).tolist() == counts.tolist() and [p.sum() for p in parts] == np.diff(starts).tolist()
    large = 10**7 * counts
    parts = [forest._share(large, 10**7 * starts, b, [1, 2]) for b in range(4)]
    assert sum(parts).tolist() == large.tolist() and [p.sum() for p in parts] == (10**7 * np.diff(starts)).tolist()


def test_trees_are_the_best_splits_of_their_bags(blocks, monkeypatch):
    coded, mixed = blocks
    codes, kind, bag = unpacked(mixed)
    grown = forest.grow(mixed, coded, 3, 4, 9)
    monkeypatch.setattr(forest, "CELLS", 1)  # one column at a time
    alone = forest.grow(mixed, coded, 3, 4, 9)
    gini = lambda s: 1 - ((s / s.sum()) ** 2).sum()
    for t, tree in enumerate(grown):
        assert {k: (v.column, v.cut, v.stats.tolist()) for k, v in tree.items()} == {k: (v.column, v.cut, v.stats.tolist()) for k, v in alone[t].items()}
        rows = {1: np.ones(len(codes), bool)}
        for k in sorted(tree):
            own, count = rows[k], lambda r, t=t: np.bincount(kind[r], bag[t, r], 3)
            assert tree[k].stats.tolist() == count(own).tolist()
            if tree[k].column < 0:
                continue
            seen = np.random.default_rng([9, 3, t, k]).choice(6, 3, replace=False)
            gains = {}
            for c in seen.tolist():
                for cut in range(31):
                    left, right = count(own & (codes[:, c] <= cut)), count(own & (codes[:, c] > cut))
                    if left.sum() and right.sum():
                        gains[c, cut] = gini(left + right) - (left.sum() * gini(left) + right.sum() * gini(right)) / (left + right).sum()
            assert tree[k].gain == pytest.approx(max(gains.values())) == pytest.approx(gains[tree[k].column, tree[k].cut])
            rows[2 * k], rows[2 * k + 1] = own & (codes[:, tree[k].column] <= tree[k].cut), own & (codes[:, tree[k].column] > tree[k].cut)
    assert sum(v.column >= 0 for tree in grown for v in tree.values()) > 9
    names = [*X, "sa", "sb", "sc"]
    found = attribution.attribute_nodes(forest.node_rows(grown))
    got = {r["feature"]: r["importance"] for r in attribution.shap_importance(found, mixed, names).collect()}
    assert np.allclose([got[c] for c in names], np.abs(found.values(codes.astype(float))).sum(2).mean(0))


def test_two_classes_need_one_output(spark, table):
    _, _, df = table
    coded = forest.code(df.withColumn("y", (df["a"] > 0.2).cast("int")), X, "y", 2)
    mixed = forest.mixed(coded, 1, 2).persist()
    found = attribution.attribute_nodes(forest.node_rows(forest.grow(mixed, coded, 2, 3, 1)))
    assert found.halved()[1] == 2
    got = {r["feature"]: r["importance"] for r in attribution.shap_importance(found, mixed, [*X, "sa", "sb", "sc"]).collect()}
    assert np.allclose(list(map(got.get, [*X, "sa", "sb", "sc"])), np.abs(found.values(unpacked(mixed)[0].astype(float))).sum(2).mean(0))


def test_boruta_shuffles_no_rows_and_reads_the_table_for_codes_only(table, monkeypatch):
    def fail(*_):
        raise AssertionError("rows were mixed")

    monkeypatch.setattr(screens, "shadows", fail)
    _, _, df = table
    read = []
    drop = type(df).dropna
    monkeypatch.setattr(type(df), "dropna", lambda self, *a, **k: (read.append(1), drop(self, *a, **k))[1])
    got = {r["feature"]: r["status"] for r in screens.boruta(df.selectExpr("a", "rand(3) b", "rand(4) c", "int(a > 0) y"), X, "y", trials=8, trees=5, depth=3).collect()}
    assert got["a"] == "accepted" and len(read) == 1
