"""Random forests for screens that grow many: rows are coded once into bytes, and each level of all trees is one pass of histograms.

A tree sees a column only through at most BINS intervals, so a row is a byte a column. Rows are held in
blocks; copies of the columns in random order (shadows) and the trees' bags are made in each block from
seeds, so nothing is shuffled but histograms. The trees are grown as those of ml: bags with replacement, a random
subset of the columns for each node, the split of greatest Gini gain, and leaves that predict the same class made one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.lineage import cut_lineage

#: Intervals of a column at most, rows of a block, and blocks of a task.
BINS, BLOCK, TOGETHER = 32, 65_536, 16
#: Rows from which halves share a column's values evenly, no longer at random: numpy's limit.
LARGE = 10**9
#: Rows whose SHAP values are worked out at a time, and cells of a histogram of several columns at once and of all that a task holds of these.
CHUNK, CELLS, HELD = 8192, 1 << 15, 1 << 23


@dataclass(frozen=True)
class Coded:
    """``blocks`` (_b, _n, _codes [column, row], _class) of a table, the first row of each block, each column's number of values by interval, and the number of classes."""

    blocks: DataFrame
    starts: dict[int, int]
    counts: np.ndarray
    classes: int


def find_cuts(df: DataFrame, columns: Sequence[str]) -> tuple[int, list[np.ndarray]]:
    """The number of rows, and for each column the upper ends of its intervals but the last: of each value if there are at most BINS, else quantiles."""
    x, p = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], len(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, [np.zeros(0)] * p
        for batch in batches:
            n += batch.num_rows
            for i, own in enumerate(found):
                if len(own) <= BINS:  # one more tells that there are too many
                    found[i] = np.union1d(own, batch.column(i).to_numpy(zero_copy_only=False))[: BINS + 1]
        yield pa.record_batch({"i": pa.array([-1, *range(p)], pa.int32()), "n": pa.array([n] + [0] * p, pa.int64()), "v": pa.array([[], *found], pa.list_(pa.float64()))})

    n, values = 0, [np.zeros(0)] * p
    for r in df.select(*x).mapInArrow(task, "i int, n bigint, v array<double>").collect():
        n += r["n"]
        if r["i"] >= 0:
            values[r["i"]] = np.union1d(values[r["i"]], r["v"])[: BINS + 1]
    if not n:
        raise ValueError("no rows to fit on")
    many, share = [i for i in range(p) if len(values[i]) > BINS], [i / BINS for i in range(1, BINS)]
    if many:
        row = df.select(*x).agg(*[f.alias(f"{k}{i}") for i in many for k, f in (("q", F.percentile_approx(f"c{i}", share, 10_000)), ("m", F.max(f"c{i}")))]).first()
        for i in many:
            values[i] = np.append(np.unique([v for v in row[f"q{i}"] if v < row[f"m{i}"]]), row[f"m{i}"])
    return n, [v[:-1] for v in values]


def code(df: DataFrame, columns: Sequence[str], label: str, classes: int) -> Coded:
    """The rows in blocks; ``label`` has whole numbers below ``classes``, and no column has a null."""
    p, (n, cuts) = len(columns), find_cuts(df, columns)

    def block(parts: list[np.ndarray]) -> pa.RecordBatch:
        held = np.concatenate(parts, 1)
        codes, kind = held[:p].astype(np.uint8), held[p].astype(np.uint16)
        counts = np.stack([np.bincount(c, minlength=BINS) for c in codes]).ravel()
        made = {"_n": pa.array([len(kind)], pa.int64()), "_codes": pa.array([codes.tobytes()], pa.binary()), "_class": pa.array([kind.tobytes()], pa.binary())}
        return pa.record_batch(made | {"_counts": pa.array([counts], pa.list_(pa.int64()))})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            part = np.stack([*[np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)], batch.column(p).to_numpy(zero_copy_only=False)]).astype(np.uint16)
            while part.shape[1]:
                parts.append(part[:, : BLOCK - size])
                size, part = size + parts[-1].shape[1], part[:, BLOCK - size :]
                if size == BLOCK:
                    yield block(parts)
                    parts, size = [], 0
        if parts:
            yield block(parts)

    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], F.col(label).cast("int").alias("y"))
    made = rows.mapInArrow(task, "_n bigint, _codes binary, _class binary, _counts array<bigint>").repartition(max(1, -(-n // (BLOCK * TOGETHER))))
    made = cut_lineage(made.withColumn("_b", F.monotonically_increasing_id()))
    sums = made.select(F.posexplode("_counts").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(p * BINS, np.int64)
    for r in sums:
        counts[r["i"]] = r["n"]
    starts, at = {}, 0
    for r in sorted(made.select("_b", "_n").collect()):
        starts[r["_b"]], at = at, at + r["_n"]
    return Coded(made.drop("_counts"), starts, counts.reshape(p, BINS), classes)


def _share(counts: np.ndarray, starts: np.ndarray, block: int, seed: Sequence[int]) -> np.ndarray:
    """How many of each value a block gets if all are dealt at random: those of halves of the blocks, of halves of these and so on, the same in each task."""
    low, high = 0, len(starts) - 1
    while high - low > 1:
        middle = (low + high) // 2
        take = int(starts[middle] - starts[low])
        if counts.sum() < LARGE:
            left = np.random.default_rng([*seed, low, high]).multivariate_hypergeometric(counts, take, method="marginals")
        else:
            ends = np.append(0, np.cumsum(counts).astype(object) * take // int(counts.sum()))
            left = np.diff(ends).astype(np.int64)
        counts, low, high = (left, low, middle) if block < middle else (counts - left, middle, high)
    return counts


@cache
def _law() -> tuple[np.ndarray, np.ndarray]:
    """The law of Poisson numbers of mean 1, and the number of each of 2**16 cells of it, 255 if there are several."""
    law = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(30)])
    edge = np.arange(1 << 16) / (1 << 16)
    first, last = np.searchsorted(law, edge, side="right"), np.searchsorted(law, edge + 1 / (1 << 16), side="left")
    return law, np.where(first == last, first, 255).astype(np.uint8)


def _bag(rng: np.random.Generator, size: int) -> np.ndarray:
    """Poisson numbers of mean 1; in a cell of several numbers a finer draw decides."""
    law, table = _law()
    cell = rng.integers(0, 1 << 16, size, dtype=np.uint16)
    out = table[cell]
    odd = np.flatnonzero(out == 255)
    out[odd] = np.searchsorted(law, (cell[odd] + rng.random(len(odd))) / (1 << 16), side="right").clip(0, 254)
    return out


def mixed(coded: Coded, seed: int, trees: int) -> DataFrame:
    """(_n, _codes, _class, _bag) of blocks: the columns' codes, then those of the shadows, all values of a column in random order; and how often each tree takes each row."""
    numbers = {b: i for i, b in enumerate(coded.starts)}
    starts = np.array([*coded.starts.values(), int(coded.counts[0].sum())])
    counts = coded.counts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b, parts = numbers[r["_b"]], [r["_codes"]]
                for j, whole in enumerate(counts):
                    values = np.repeat(np.arange(BINS, dtype=np.uint8), _share(whole, starts, b, [seed, 0, j]))
                    np.random.default_rng([seed, 1, j, b]).shuffle(values)
                    parts.append(values.tobytes())
                bag = _bag(np.random.default_rng([seed, 2, b]), trees * r["_n"])
                made = {"_codes": b"".join(parts), "_class": r["_class"], "_bag": bag.tobytes()}
                yield pa.record_batch({"_n": pa.array([r["_n"]], pa.int64())} | {k: pa.array([v], pa.binary()) for k, v in made.items()})

    return coded.blocks.mapInArrow(task, "_n bigint, _codes binary, _class binary, _bag binary")


def _bytes(batch: pa.RecordBatch, name: str, row: int, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), kind)


def matrices(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """[row, column] of codes, a few rows at a time."""
    for row in range(batch.num_rows):
        codes = _bytes(batch, "_codes", row).reshape(-1, batch.column("_n")[row].as_py())
        for at in range(0, codes.shape[1], CHUNK):
            yield codes[:, at : at + CHUNK].T


@dataclass
class Node:
    """A node of a tree, numbered as in a heap from 1: rows by class, and if it is split the column, the last code on the left, and the gain."""

    stats: np.ndarray
    column: int = -1
    cut: int = 0
    gain: float = 0.0


#: The splits of a tree so far by depth, and the columns that the open nodes look at.
Plan = tuple[list[dict[int, tuple[int, int]]], dict[int, list[int]]]


def _columns(plan: Plan) -> dict[int, list[int]]:
    """The open nodes that look at each column."""
    out: dict[int, list[int]] = {}
    for node, own in sorted(plan[1].items()):
        for c in own:
            out.setdefault(c, []).append(node)
    return dict(sorted(out.items()))


def _together(columns: Sequence[int], bins: np.ndarray, most: int) -> list[tuple[int, ...]]:
    """The columns in groups of at most ``most`` cells: rows are counted once a group, not once a column."""
    groups: list[list[int]] = []
    for c in sorted(columns, key=lambda c: (-bins[c], c)):
        fits = [g for g in groups if math.prod(int(bins[k]) for k in [*g, c]) <= most]
        fits[0].append(c) if fits else groups.append([c])
    return [tuple(sorted(g)) for g in groups]


def _descend(codes: np.ndarray, levels: list[dict[int, tuple[int, int]]]) -> np.ndarray:
    """The node of each row, or 0 if it has come to a leaf."""
    node = np.ones(codes.shape[1], np.uint8 if len(levels) < 7 else np.int64)
    for splits in levels:
        right, inner = np.zeros(len(node), bool), np.zeros(len(node), bool)
        for one, (column, cut) in splits.items():
            here = node == one
            inner |= here
            right |= here & (codes[column] > cut)
        node = (2 * node + right) * inner
    return node


def histograms(blocks: DataFrame, plans: dict[int, Plan], bins: np.ndarray, classes: int) -> dict[int, np.ndarray]:
    """For each tree [node of a column, bin, class], column by column as in ``_columns``: the rows of the tree's bag. ``bins`` has each column's number."""
    asked = {t: _columns(plan) for t, plan in plans.items()}
    most = min(CELLS, HELD // sum(len(own) for own in asked.values()))
    groups = {t: _together(list(asked[t]), bins, most // ((len(plan[1]) + 1) * classes)) for t, plan in plans.items()}
    shapes = {(t, g): [len(plans[t][1]) + 1, *(int(bins[c]) for c in g), classes] for t, own in groups.items() for g in own}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {key: np.zeros(math.prod(shape)) for key, shape in shapes.items()}
        # The open nodes of a tree in order, then all others.
        numbers = {t: np.full(2 << len(levels), len(looked)) for t, (levels, looked) in plans.items()}
        for t, number in numbers.items():
            number[sorted(plans[t][1])] = np.arange(len(plans[t][1]))
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("_n")[row].as_py()
                codes, kind = _bytes(batch, "_codes", row).reshape(-1, n), _bytes(batch, "_class", row, np.uint16)
                bag = _bytes(batch, "_bag", row).reshape(-1, n)
                places: dict[tuple[int, ...], np.ndarray] = {}
                for t, (levels, looked) in plans.items():
                    weight, at = bag[t].astype(float), numbers[t][_descend(codes, levels)] if levels else 0
                    for group in groups[t]:
                        if group not in places:
                            place = np.zeros(n, np.int64)
                            for c in group:
                                place *= bins[c]
                                place += codes[c]
                            place *= classes
                            place += kind
                            places[group] = place
                        whole = sums[t, group]
                        whole += np.bincount(at * (len(whole) // (len(looked) + 1)) + places[group], weight, len(whole))
        for t, own in asked.items():
            out = {c: np.zeros((len(nodes), BINS, classes)) for c, nodes in own.items()}
            for group in groups[t]:
                whole = sums[t, group].reshape(shapes[t, group])
                for k, c in enumerate(group):
                    out[c][:, : bins[c]] = whole.sum(tuple(j + 1 for j in range(len(group)) if j != k))[numbers[t][own[c]]]
            yield pa.record_batch({"t": pa.array([t], pa.int32()), "h": pa.array([np.concatenate([h.ravel() for h in out.values()])], pa.list_(pa.float64()))})

    def add(table: pa.Table) -> pa.Table:
        total = sum(r.values.to_numpy() for r in table.column("h"))
        return pa.table({"t": table.column("t")[:1], "h": pa.array([total], pa.list_(pa.float64()))})

    met = blocks.mapInArrow(task, "t int, h array<double>").groupBy("t").applyInArrow(add, "t int, h array<double>")
    return {r["t"]: np.array(r["h"]).reshape(-1, BINS, classes) for r in met.collect()}


def _gini(stats: np.ndarray) -> np.ndarray:
    n = stats.sum(-1, keepdims=True)
    return 1 - ((stats / np.maximum(n, 1)) ** 2).sum(-1)


def _best(found: dict[int, np.ndarray]) -> tuple[float, int, int, np.ndarray, np.ndarray]:
    """Gain, column, last code on the left, and rows by class on both sides of the best split of a node; ``found`` is [bin, class] by column."""
    best = (0.0, -1, 0, None, None)
    for column, hist in sorted(found.items()):
        left = np.cumsum(hist, 0)[:-1]
        whole = hist.sum(0)
        right, n = whole - left, whole.sum()
        share = left.sum(1) / max(n, 1)
        gain = _gini(whole) - share * _gini(left) - (1 - share) * _gini(right)
        gain[(left.sum(1) == 0) | (right.sum(1) == 0)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), column, k, left[k], right[k])
    return best


def grow(blocks: DataFrame, coded: Coded, trees: int, depth: int, seed: int) -> list[dict[int, Node]]:
    """Trees over mixed blocks of a table, one pass a level; a node looks at about the root of the number of columns."""
    own = np.array([np.flatnonzero(c)[-1] + 1 for c in coded.counts])
    bins, columns = np.append(own, own), 2 * len(own)
    grown: list[dict[int, Node]] = [{} for _ in range(trees)]
    levels: list[list[dict[int, tuple[int, int]]]] = [[] for _ in range(trees)]
    open_ = {t: [1] for t in range(trees)}
    for _ in range(depth):
        draw = lambda t, node: sorted(np.random.default_rng([seed, 3, t, node]).choice(columns, math.ceil(math.sqrt(columns)), replace=False).tolist())
        plans = {t: (levels[t], {node: draw(t, node) for node in nodes}) for t, nodes in open_.items() if nodes}
        if not plans:
            break
        sums = histograms(blocks, plans, bins, coded.classes)
        open_ = {}
        for t, plan in plans.items():
            found: dict[int, dict[int, np.ndarray]] = {}
            for (column, node), hist in zip(((c, node) for c, own in _columns(plan).items() for node in own), sums[t], strict=True):
                found.setdefault(node, {})[column] = hist
            splits, open_[t] = {}, []
            for node, own in sorted(found.items()):
                if node == 1:
                    grown[t][1] = Node(next(iter(own.values())).sum(0))
                gain, column, cut, left, right = _best(own)
                if column < 0:
                    continue
                one = grown[t][node]
                one.column, one.cut, one.gain, splits[node] = column, cut, gain, (column, cut)
                for child, stats in ((2 * node, left), (2 * node + 1, right)):
                    grown[t][child] = Node(stats)
                    if (stats > 0).sum() > 1:  # a pure node is a leaf
                        open_[t].append(child)
            levels[t].append(splits)
    for tree in grown:
        # Leaves of a node that predict the same class are one.
        for node in sorted((k for k, v in tree.items() if v.column >= 0), reverse=True):
            left, right = tree[2 * node], tree[2 * node + 1]
            if left.column < 0 and right.column < 0 and left.stats.argmax() == right.stats.argmax():
                tree[node].column = -1
                del tree[2 * node], tree[2 * node + 1]
    return grown


def impurity_importance(grown: list[dict[int, Node]], columns: int) -> np.ndarray:
    """Each column's gains by rows, as a share of its tree's, over all trees."""
    out = np.zeros(columns)
    for tree in grown:
        own = np.zeros(columns)
        for node in tree.values():
            if node.column >= 0:
                own[node.column] += node.gain * node.stats.sum()
        out += own / (own.sum() or 1)
    return out / (out.sum() or 1)


def node_rows(grown: list[dict[int, Node]]) -> dict[int, dict[int, dict]]:
    """The nodes as ``attribution.attribute_nodes`` takes them, thresholds in codes."""
    out: dict[int, dict[int, dict]] = {}
    for t, tree in enumerate(grown):
        for k, v in tree.items():
            split = v.column >= 0
            out.setdefault(t, {})[k - 1] = {
                "left": 2 * k - 1 if split else -1, "right": 2 * k if split else -1, "feature": v.column, "threshold": float(v.cut), "categories": 0,
                "cover": float(v.stats.sum()), "stats": v.stats.tolist(), "prediction": float(v.stats.argmax()),
            }
    return out
