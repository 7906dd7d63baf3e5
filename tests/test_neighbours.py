"""The neighbour join and Euclidean silhouettes against brute force."""

import numpy as np
import pytest

from sparkchemo.operators import neighbours
from sparkchemo.operators.clusters import silhouettes


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, a hot point that a third of the rows share, ties on a grid, an outlier, and rows that take no part."""
    rng = np.random.default_rng(7)
    rows = [(i, *(float(v) for v in np.round(rng.normal(size=2) + 6 * (i % 3), 1)), "abc"[i % 3]) for i in range(120)]
    rows += [(200 + i, 1.0, 1.0, "ab"[i % 2]) for i in range(70)] + [(400, 1e6, -1e6, "z"), (401, 3.0, 3.0, None), (402, 3.0, 3.1, None)]
    odd = [(500, None, 1.0, "a"), (501, float("nan"), 1.0, "a"), (None, 1.0, 2.0, "a")]
    return rows, spark.createDataFrame(rows + odd, "id bigint, x double, y double, cls string").repartition(3).cache()


def brute(rows, k, within):
    out = {}
    for i, x, y, c in rows:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b, e in rows if j != i and (not within or e == c))[:k]
        out[i] = [(j, pytest.approx(d)) for d, j in near]
    return out


@pytest.mark.parametrize(("within", "pivots", "part"), [(False, 16, 4096), (True, 5, 13), (False, 1, 10**6), (False, 40, 7)])
def test_neighbours_equal_brute_force(points, within, pivots, part):
    rows, df = points
    got: dict = {i: [] for i, *_ in rows}
    for r in neighbours.neighbours(df, df, ["x", "y"], "id", 4, "cls", within, pivots, part).orderBy("q", "rank").collect():
        got[r["q"]].append((r["id"], r["d"]))
        assert rows[[x[0] for x in rows].index(r["id"])][1:3] == tuple(r["x"])
    assert got == brute(rows, 4, within)


def test_text_keys_and_empty_tables(spark, points):
    rows, df = points
    named = df.withColumn("id", df["id"].cast("string"))
    near = neighbours.neighbours(named.where("id = '0'"), named, ["x", "y"], "id", 3).orderBy("rank").collect()
    want = sorted(((a - rows[0][1]) ** 2 + (b - rows[0][2]) ** 2, str(j)) for j, a, b, _ in rows if j)[:3]
    assert [(r["id"], r["q"]) for r in near] == [(j, "0") for _, j in want]
    assert neighbours.neighbours(df.limit(0), df, ["x"], "id", 2).count() == neighbours.neighbours(df, df.limit(0), ["x"], "id", 2).count() == 0


@pytest.mark.parametrize("block", [2048, 17])
def test_silhouettes_equal_brute_force(points, block):
    rows, df = points
    x = np.array([r[1:3] for r in rows if r[3]])
    cls = np.array([r[3] for r in rows if r[3]])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {}
    for i, r in enumerate(r for r in rows if r[3]):
        own = cls == cls[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, cls == c].mean() for c in set(cls) - {cls[i]})
        want[r[0]] = (r[3], 0.0 if own.sum() == 1 else (b - a) / max(a, b))
    got = {r["id"]: (r["cls"], r["silhouette"]) for r in silhouettes(df.where("id is not null"), ["x", "y"], "cls", "id", block).collect()}
    assert got == {k: (c, pytest.approx(s, abs=1e-12)) for k, (c, s) in want.items()}


def test_silhouettes_without_a_second_cluster_or_a_distance(spark):
    one = spark.createDataFrame([(1, 0.0, 5), (2, 1.0, 5)], "id int, x double, c int")
    assert [r["silhouette"] for r in silhouettes(one, ["x"], "c", "id").collect()] == [None, None]
    same = spark.createDataFrame([(1, 2.0, 5), (2, 2.0, 5), (3, 2.0, 6)], "id int, x double, c int")
    assert {r["silhouette"] for r in silhouettes(same, ["x"], "c", "id").collect()} == {0.0}


def test_scaled_neighbours_order_near_ties_as_unscaled_ones(spark):
    """Values on a grid of cents: dividing by the deviation would order neighbours that are about as far otherwise."""
    from sparkchemo.operators.rebalance import scaled_smote_enn

    x = np.random.default_rng(20).integers(0, 3000, 200) / 100
    df = spark.createDataFrame([(i, float(v), str(i % 2)) for i, v in enumerate(x)], "id long, x double, cls string")
    kept = set()
    for i in range(200):
        near = sorted((abs(x[j] - x[i]), str(j), j) for j in range(200) if j != i)[:3]
        if sum((j - i) % 2 == 0 for *_, j in near) >= 2:
            kept.add(str(i))
    assert {r["id"] for r in scaled_smote_enn(df, ["x"], "cls", "id", kind="mode").collect()} == kept


def test_rows_that_are_alike_are_one_point():
    """A block's sums count each point as often as it has rows, however many clusters a tile holds."""
    import pyarrow as pa

    from sparkchemo.operators.clusters import _distance_sums

    rng = np.random.default_rng(1)
    x, y, own, other = rng.normal(size=(150, 2)), rng.normal(size=(90, 2)), rng.integers(0, 4, 150), rng.integers(2, 6, 90)
    w, v = rng.integers(1, 9, 150), rng.integers(1, 9, 90)
    block = lambda z, c, n, b: pa.table({"_id": np.arange(len(z)) + 1000 * b, "_c": c, "_x": pa.array(z.tolist()), "_w": n, "_block": np.full(len(z), b)})
    got = {(r["_id"], r["_c"]): r["_s"] for r in _distance_sums(block(x, own, w, 0), block(y, other, v, 1)).to_pylist()}
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    want = {(i, c): (d[i] * v)[other == c].sum() for i in range(150) for c in set(other.tolist())}
    want |= {(1000 + j, c): (d[:, j] * w)[own == c].sum() for j in range(90) for c in set(own.tolist())}
    assert got == {k: pytest.approx(s) for k, s in want.items()}


def test_pairs_compared_grow_as_the_points(monkeypatch):
    """Four columns of few values but one: a query meets a few leaves, however many points its box has."""
    pairs, gaps = [], neighbours._gaps
    monkeypatch.setattr(neighbours, "_gaps", lambda x, y: pairs.append(len(x) * len(y)) or gaps(x, y))
    rng, each = np.random.default_rng(3), {}
    for n in (4000, 16000):
        x = np.stack([rng.integers(0, 50, n) / 14, rng.normal(size=n), rng.integers(0, 11, n) / 3, rng.integers(0, 9, n) / 2.6], 1)
        rank, asked = rng.permutation(n), rng.choice(n, 60, replace=False)
        pairs.clear()
        query, point, _ = neighbours._search(x, rank, x, rank, np.full(n, np.inf), 3)
        each[n] = sum(pairs) / n
        for i in asked:
            d = ((x - x[i]) ** 2 * 1.0).sum(1)
            d[i] = np.inf
            assert point[query == i].tolist() == np.lexsort((rank, d))[:3].tolist()
    assert each[16000] < 1000 and each[16000] < 1.5 * each[4000]


@pytest.mark.parametrize(("within", "boxes", "part"), [(False, 12, 40), (True, 12, 40), (True, 1, 10**6)])
def test_queries_apart_from_points_ties_and_rare_labels(spark, within, boxes, part):
    """A grid full of ties, frequent and rare labels and none, a crowd of points and one of queries far from all points."""
    rng = np.random.default_rng(11)
    label = lambda i: "ab"[i % 2] if i % 10 else f"r{i % 70}" if i % 20 else None
    points = [(i, *(float(v) for v in rng.integers(0, 9, 3)), label(i)) for i in range(900)] + [(1000 + i, 4.0, 4.0, 4.0, label(i)) for i in range(400)]
    asked = points[::9] + [(5000 + i, 30.0, 30.0, float(i % 2), label(i)) for i in range(200)]
    kinds = "id int, x double, y double, z double, cls string"
    got = neighbours.neighbours(spark.createDataFrame(asked, kinds), spark.createDataFrame(points, kinds).repartition(3), ["x", "y", "z"], "id", 3, "cls", within, boxes, part)
    found: dict = {}
    for r in got.orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append((r["d"], r["id"], r["label"], *r["x"]))
    for i, *at, c in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(at, to, strict=True)), j, e or "", *to) for j, *to, e in points if j != i and (not within or e == c))[:3]
        assert [(d, j, e or "", *to) for d, j, e, *to in found.get(i, [])] == near


def test_edited_neighbours_of_odd_rows(spark):
    """A row that occurs twice votes once on itself; a neighbour without a label does not agree; nobody is edited without neighbours."""
    from sparkchemo.operators.rebalance import edited_neighbours

    kinds = "id string, x double, cls string"
    rows = [("p", 0.0, "b"), ("p", 0.0, "b"), ("q", 0.1, "b"), ("r", 0.2, "b"), ("s", 0.3, "a"), ("t", 9.0, "b"), ("u", 9.1, None), ("v", 9.2, None), ("w", 9.3, None)]
    left = edited_neighbours(spark.createDataFrame(rows, kinds), ["x"], "cls", "id", kind="mode")
    assert sorted(r["id"] for r in left.collect()) == ["p", "p", "q", "r", "s", "u", "v", "w"]
    assert edited_neighbours(spark.createDataFrame(rows[:1], kinds), ["x"], "cls", "id", spare="z").count() == 1


def test_points_of_a_label_without_queries_reach_nothing():
    tree = neighbours._Tree(np.random.default_rng(0).normal(size=(50, 2)), 8)
    assert [len(a) for a in tree.reach(np.zeros((0, 2)), np.zeros(0), 3)] == [0, 0]


@pytest.mark.parametrize("kind", ["one column", "few lines", "three columns", "few points at large offsets"])
def test_points_on_few_lines_do_not_meet_in_pairs(spark, monkeypatch, kind):
    """Sums along the lines equal brute force, with rows alike, a cluster of one row and several parts of a line."""
    from sparkchemo.operators import clusters

    def fail(*_):
        raise AssertionError("pairs of points met")

    monkeypatch.setattr(clusters, "_distance_sums", fail)
    monkeypatch.setattr(clusters, "HELD", 700)
    rng, n = np.random.default_rng(5), 3000
    t = np.round(rng.uniform(-50, 950, n) ** 2 / 1000, 2)
    x = {
        "one column": t[:, None],
        "few lines": np.stack([t, rng.choice([0.0, 300.0, 900.0, 1000.0], n)], 1),
        "three columns": np.stack([rng.integers(0, 2, n) * 300.0, t, rng.integers(0, 3, n) * 400.0], 1),
        "few points at large offsets": np.stack([t + 1e9, rng.integers(0, 3, n) * 500.0 - 1e9], 1),
    }[kind]
    x[2900:] = x[:100]
    c = rng.integers(0, 4, n)
    c[17] = 7
    df = spark.createDataFrame([(i, *map(float, v), f"c{k}") for i, (v, k) in enumerate(zip(x, c, strict=True))], "id int, " + "".join(f"x{j} double, " for j in range(x.shape[1])) + "c string")
    got = {r["id"]: (r["c"], r["silhouette"]) for r in clusters.silhouettes(df, [f"x{j}" for j in range(x.shape[1])], "c", "id").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    names, size = np.unique(c, return_counts=True)
    sums = np.stack([d[:, c == k].sum(1) for k in names], 1)
    assert len(got) == n
    for i in range(n):
        own = int(np.searchsorted(names, c[i]))
        a = sums[i, own] / max(1, size[own] - 1)
        b = min(sums[i, k] / size[k] for k in range(len(names)) if k != own)
        assert got[i] == (f"c{c[i]}", pytest.approx(0.0 if size[own] == 1 else (b - a) / max(a, b), abs=1e-12))
