"""SHAP values of ml forests: what each feature adds to a row's prediction, from the trees' node tables.

A leaf is reached if the row passes every split on its path, so a leaf's part of the value of a
feature set follows, for each feature of the path, from whether the row passes that feature's
splits, and else from the share of training rows that do. A path of m features has 2**m such cases; their
Shapley values are a small table for each leaf, made once. A tree's thresholds cut each feature into few intervals, so
the sums over its leaves are a table too, by interval; scoring looks up a row in each tree's
table (or, where that would be large, in each leaf's), in one pass over the rows, whatever their number.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.lineage import shared_folder
from sparkchemo.operators import forest

#: Features on a path at most: a leaf's table has 2**DEEPEST rows.
DEEPEST = 12
#: Rows of a tree's table at most; a tree with more combinations of intervals is looked up leaf by leaf.
MOST = 1 << 13


@dataclass(frozen=True)
class Leaf:
    """Features of the path, the interval (low, high] that each must be in, the share of rows that are, and the leaf's values."""

    features: tuple[int, ...]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray

    def table(self) -> np.ndarray:
        """[case, feature]: the Shapley value of each feature if bit j of the case says that the row passes feature j's splits."""
        m = len(self.features)
        passes = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
        weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
        out = np.zeros((1 << m, m))
        for j in range(m):
            # Coefficient s: sums over sets of s other features, known ones by case, unknown ones by share.
            poly = np.zeros((1 << m, m))
            poly[:, 0] = 1
            for i in (i for i in range(m) if i != j):
                moved = np.zeros_like(poly)
                moved[:, 1:] = poly[:, :-1] * passes[:, i : i + 1]
                poly = poly * self.share[i] + moved
            out[:, j] = (passes[:, j] - self.share[j]) * (poly @ weight)
        return out


def _by_leaves(leaves: Sequence[tuple[Leaf, np.ndarray]], x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out`` [row, feature, output] with the values of the leaves added."""
    for leaf, table in leaves:
        case = np.zeros(len(x), np.int64)
        for j, f in enumerate(leaf.features):
            case |= ((x[:, f] > leaf.low[j]) & (x[:, f] <= leaf.high[j])).astype(np.int64) << j
        for j, f in enumerate(leaf.features):
            out[:, f] += table[case, j][:, None] * leaf.value
    return out


@dataclass(frozen=True)
class Attribution:
    """Leaves of all trees, each with its table and value; values are divided by the number of trees.

    ``trees`` has for each tree its features' ascending thresholds and its leaves.
    """

    trees: list[tuple[dict[int, np.ndarray], list[tuple[Leaf, np.ndarray]]]]
    expected: np.ndarray

    def values(self, x: np.ndarray) -> np.ndarray:
        """[row, feature, output] of a matrix of features; NaN passes no upper bound, as in the trees."""
        return self.lookup(x.shape[1])(x)

    def halved(self) -> tuple[Attribution, int]:
        """What has the same values but for their signs, and how often: the first of two classes, whose probabilities sum to 1."""
        leaves = [leaf for _, own in self.trees for leaf, _ in own]
        if len(self.expected) != 2 or not np.allclose([leaf.value.sum() for leaf in leaves], 1 / len(self.trees), rtol=1e-12, atol=0):
            return self, 1
        return Attribution([(cuts, [(replace(leaf, value=leaf.value[:1]), table) for leaf, table in own]) for cuts, own in self.trees], self.expected[:1]), 2

    def lookup(self, p: int) -> Callable[[np.ndarray], np.ndarray]:
        """``values`` for matrices of ``p`` features, with the trees' tables made once."""
        k = len(self.expected)
        tables, rest = [], []
        for cuts, leaves in self.trees:
            size = math.prod(len(c) + 1 for c in cuts.values())
            if size > MOST:
                rest += leaves
                continue
            ends = np.meshgrid(*[np.append(c, np.inf) for c in cuts.values()], indexing="ij")  # each interval's upper end stands for it
            rows = np.zeros((size, p))
            for f, e in zip(cuts, ends, strict=True):
                rows[:, f] = e.ravel()
            tables.append((cuts, _by_leaves(leaves, rows, np.zeros((size, p, k))).reshape(size, -1)))
        every = {f: np.unique(np.concatenate([c[f] for c, _ in tables if f in c])) for f in range(p) if any(f in c for c, _ in tables)}
        steps = []
        for cuts, table in tables:
            stride, own = len(table), []
            for f, c in cuts.items():
                stride //= len(c) + 1
                own.append((f, np.searchsorted(c, np.append(every[f], np.inf)) * stride))
            steps.append((own, table))

        codes = {f: np.searchsorted(c, np.arange(256)) for f, c in every.items()}

        def values(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), p * k))
            if x.dtype == np.uint8:
                place = {f: c[x[:, f]] for f, c in codes.items()}
            else:
                x = np.where(np.isnan(x), np.inf, x)
                place = {f: np.searchsorted(c, x[:, f]) for f, c in every.items()}
            for own, table in steps:
                row = np.zeros(len(x), np.int64)
                for f, code in own:
                    row += code[place[f]]
                out += table[row]
            return _by_leaves(rest, x, out.reshape(len(x), p, k))

        return values


def node_table(model, spark) -> DataFrame:
    """(tree, id, left, right, feature, threshold, cover, stats, prediction): the nodes of an ml forest, as it saves them in the shared folder."""
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    n = F.col("nodeData")
    columns = {"id": n["id"], "left": n["leftChild"], "right": n["rightChild"], "feature": n["split"]["featureIndex"], "threshold": F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))}
    rest = {"categories": n["split"]["numCategories"], "cover": n["rawCount"], "stats": n["impurityStats"], "prediction": n["prediction"]}
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), *[c.alias(k) for k, c in (columns | rest).items()])


def attribute(model, spark, classes: bool = True) -> Attribution:
    """The tables of a forest of ml: outputs are the classes' probabilities, or with ``classes`` false the prediction.

    The nodes come to the driver: as many as the forest's own size, which the driver holds already. Splits on
    categories and paths of over DEEPEST features are an error.
    """
    trees: dict[int, dict[int, object]] = {}
    for r in node_table(model, spark).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r
    return attribute_nodes(trees, classes)


def attribute_nodes(trees: dict[int, dict], classes: bool = True) -> Attribution:
    """``attribute`` of nodes by tree and number, each with the columns of a node table; 0 is the root."""
    found, expected = [], 0.0
    for nodes in trees.values():
        leaves: list[tuple[Leaf, np.ndarray]] = []
        cuts: dict[int, set[float]] = {}

        def value(r) -> np.ndarray:
            return np.array(r["stats"]) / sum(r["stats"]) if classes else np.array([r["prediction"]])

        # A path: node and, by feature, (low, high, share).
        paths = [(nodes[0], {})]
        while paths:
            r, held = paths.pop()
            if r["left"] < 0:
                if len(held) > DEEPEST:
                    raise ValueError(f"a path has more than {DEEPEST} features")
                own = sorted(held)
                low, high, share = (np.array([held[f][k] for f in own]) for k in range(3))
                leaf = Leaf(tuple(own), low, high, share, value(r) / len(trees))
                leaves.append((leaf, leaf.table()))
                expected = expected + leaf.value * r["cover"] / nodes[0]["cover"]
                continue
            if r["categories"] > 0:
                raise ValueError("a split on categories")
            cuts.setdefault(r["feature"], set()).add(r["threshold"])
            a, b, z = held.get(r["feature"], (-math.inf, math.inf, 1.0))
            left, right = nodes[r["left"]], nodes[r["right"]]
            paths.append((left, held | {r["feature"]: (a, min(b, r["threshold"]), z * left["cover"] / r["cover"])}))
            paths.append((right, held | {r["feature"]: (max(a, r["threshold"]), b, z * right["cover"] / r["cover"])}))
        found.append(({f: np.array(sorted(c)) for f, c in cuts.items()}, leaves))
    return Attribution(found, np.atleast_1d(expected))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _features(columns: Sequence[str]):
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("_x")


def shap_values(found: Attribution, df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(key, output, values): for each row and output (class number) one value by feature; with ``expected`` they sum to the prediction.

    ``columns`` are the forest's features in order. Null and NaN pass no upper bound, as in the trees.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = found.lookup(len(columns))
        for batch in batches:
            v = values(_matrix(batch)).transpose(0, 2, 1)
            n, k, p = v.shape
            row = pa.array(np.repeat(np.arange(n), k))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k * p + 1, p, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(row), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), lists], [key, "output", "values"])

    return df.select(key, _features(columns)).mapInArrow(task, f"`{key}` {df.schema[key].dataType.simpleString()}, output int, values array<double>")


def shap_importance(found: Attribution, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, importance): the mean absolute value over the rows, summed over the outputs; a task sends a row a feature.

    ``df`` has the columns, or is mixed blocks of codes (``forest.mixed``) of a forest over these.
    """
    names = list(columns)
    coded = "_codes" in df.columns
    found, times = found.halved()
    split = forest.matrices if coded else lambda batch: [_matrix(batch)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, total, n = found.lookup(len(names)), np.zeros(len(names)), 0
        for batch in batches:
            for x in split(batch):
                total += times * np.abs(values(x)).sum((0, 2))
                n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([n] * len(names))], ["feature", "s", "n"])

    sums = (df.select("_n", "_codes") if coded else df.select(_features(columns))).mapInArrow(task, "feature string, s double, n bigint")
    return sums.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("importance"))
