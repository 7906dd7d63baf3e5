"""Cluster screens: the elbow curve and silhouettes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.expr import total
from sparkchemo.functions.lineage import cut_lineage

#: Clusters whose moments are broadcast at most.
FEW = 10_000
#: Points of a block that meets other blocks, at least and at most; between, as many as make about BLOCKS blocks.
BLOCK, WIDEST, BLOCKS = 2048, 65_536, 32
#: Degree of the polynomials that stand for distances to other lines, less one: over an interval as long as the lines
#: are apart their error falls by 4.2 with each degree, so it is below a double's rounding.
DEGREE = 26
#: Lines, nodes of all their intervals, and nodes times clusters at most; with more, blocks of points meet.
LINES, NODES, WEIGHTS = 1024, 1 << 17, 1 << 22
#: What a pair of nodes costs in squared points, up to which lines pay; and points of a line that a task holds.
PAYS, HELD = 0.5, 65_536


def elbow(df: DataFrame, columns: Sequence[str], clusters: Sequence[int] = range(1, 11), seed: int = 0) -> DataFrame:
    """(k, inertia) of k-means for each k; one cluster is the total sum of squares."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df.select(*columns)).select("_x", *columns).persist()
    try:
        out = []
        for k in clusters:
            if k == 1:
                cost = rows.agg(total([F.var_pop(c) for c in columns]) * F.count(F.lit(1))).first()[0]
            else:
                cost = KMeans(k=k, seed=seed, featuresCol="_x", maxIter=100).fit(rows).summary.trainingCost
            out.append((int(k), float(cost)))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, inertia double")


def _weights(own: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """[cluster, point]: how many rows of each cluster a point stands for."""
    out = np.zeros((n, len(own)))
    out[own, np.arange(len(own))] = weight
    return out


def _distance_sums(table_a: pa.Table, table_b: pa.Table) -> pa.Table:
    """For each point of either block the sums of its distances to the rows of each cluster of the other block; a block meets itself once."""
    a, b = table_a.combine_chunks(), table_b.combine_chunks()
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    parts: list[tuple] = []
    if a.num_rows and b.num_rows:
        x, y = (t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, b))
        once = a.column("_block")[0].as_py() == b.column("_block")[0].as_py()
        (names_a, own_a), (names_b, own_b) = (np.unique(t.column("_c").to_numpy(), return_inverse=True) for t in (a, b))
        weight_a, weight_b = (t.column("_w").to_numpy().astype(float) for t in (a, b))
        to_b, to_a = np.zeros((len(x), len(names_b))), np.zeros((len(names_a), len(y)))
        # Tiles that stay in a core's cache.
        for v in range(0, len(y), 2048):
            part = np.ascontiguousarray(y[v : v + 2048].T)
            (near, local_b) = np.unique(own_b[v : v + 2048], return_inverse=True)
            of_b = np.ascontiguousarray(_weights(local_b, weight_b[v : v + 2048], len(near)).T)
            for u in range(0, len(x), 64):
                rows = x[u : u + 64]
                d = np.subtract.outer(rows[:, 0], part[0])
                d *= d
                for k in range(1, len(part)):
                    gap = np.subtract.outer(rows[:, k], part[k])
                    gap *= gap
                    d += gap
                np.sqrt(d, out=d)
                to_b[u : u + 64, near] += d @ of_b
                if not once:
                    far, local_a = np.unique(own_a[u : u + 64], return_inverse=True)
                    to_a[far, v : v + 2048] += _weights(local_a, weight_a[u : u + 64], len(far)) @ d
        for keys, sums, names in ((a.column("_id"), to_b, names_b), *([] if once else [(b.column("_id"), to_a.T, names_a)])):
            row, col = np.divmod(np.arange(sums.size), sums.shape[1])
            parts.append((pa.array(keys.to_numpy()[row]), pa.array(names[col]), pa.array(sums.ravel())))
    columns = [pa.concat_arrays([p[k] for p in parts]) if parts else pa.array([], t) for k, t in enumerate(kinds)]
    return pa.table(dict(zip(("_id", "_c", "_s"), columns, strict=True)))


@dataclass(frozen=True)
class _Lines:
    """Points on few lines along one column: which, the other columns of each line, and the column's equal intervals."""

    along: int
    others: np.ndarray
    low: float
    width: float
    intervals: int

    @property
    def nodes(self) -> np.ndarray:
        """Places of all Chebyshev nodes of a line, from its low end."""
        u = np.cos(math.pi * (np.arange(DEGREE) + 0.5) / DEGREE)
        return (self.width * (np.arange(self.intervals)[:, None] + (u + 1) / 2)).ravel()

    def place(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each place on a line, and the Chebyshev polynomials there."""
        z = (t - self.low) / self.width
        at = np.clip(np.floor(z), 0, self.intervals - 1).astype(int)
        return at, np.polynomial.chebyshev.chebvander(2 * (z - at) - 1, DEGREE - 1)


def _turn() -> np.ndarray:
    """[node, polynomial]: values at the nodes times this are coefficients; this times sums of polynomials are weights of the nodes."""
    u = np.cos(math.pi * (np.arange(DEGREE) + 0.5) / DEGREE)
    return np.polynomial.chebyshev.chebvander(u, DEGREE - 1) * np.where(np.arange(DEGREE), 2, 1) / DEGREE


def _find_lines(points: DataFrame, columns: int, n: int, clusters: int) -> _Lines | None:
    """The lines that the points are on, if they are few and the nodes of their intervals meet sooner than the points do."""
    x = [F.col("_x")[k] for k in range(columns)]
    row = points.agg(*[f(v).alias(f"{name}{k}") for k, v in enumerate(x) for name, f in (("n", F.approx_count_distinct), ("lo", F.min), ("hi", F.max))]).first()
    if n <= BLOCK or clusters > FEW or not all(math.isfinite(row[f"{e}{k}"]) for k in range(columns) for e in ("lo", "hi")):
        return None
    along = max(range(columns), key=lambda k: (row[f"n{k}"], -k))
    low, high = row[f"lo{along}"], row[f"hi{along}"]
    rest = [k for k in range(columns) if k != along]
    if not rest:
        return _Lines(along, np.zeros((1, 0)), low, 1.0, 0)
    found = points.select(F.array(*[x[k] for k in rest]).alias("_rest")).distinct().limit(LINES + 1).collect()
    if len(found) > LINES:
        return None
    others = np.array(sorted(r["_rest"] for r in found), float).reshape(len(found), len(rest))
    if len(others) == 1:
        return _Lines(along, others, low, 1.0, 0)
    apart = _apart(others)
    width = apart[apart > 0].min()
    if not (high - low) / width < NODES:
        return None
    lines = _Lines(along, others, low, float(width), max(1, math.ceil((high - low) / width)))
    nodes = len(others) * lines.intervals * DEGREE
    return None if nodes > NODES or nodes * clusters > WEIGHTS or PAYS * nodes**2 > n**2 else lines


def _apart(others: np.ndarray) -> np.ndarray:
    """Distances of lines."""
    squares = np.zeros((len(others), len(others)))
    for column in others.T:
        squares += np.subtract.outer(column, column) ** 2
    return np.sqrt(squares)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The task's points of each line, in order."""
    rows = pa.Table.from_batches(list(batches) or [pa.record_batch({"_line": pa.array([], pa.int32())})]).combine_chunks()
    line = rows.column("_line").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(line)) + 1, len(line))
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        if b > a:
            yield rows.slice(a, b - a)


def _line_sums(lines: _Lines, names: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """By line and cluster: for each interval the sums of its polynomials, and for the part of the line in the task the first place, the rows, and their distances to it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _segments(batches):
            t, w = rows.column("_t").to_numpy(), rows.column("_w").to_numpy().astype(float)
            c = np.searchsorted(names, rows.column("_c").to_numpy())
            out = {"_i": [], "_c": [], "_s": []}
            for k in np.unique(c):
                own = c == k
                out["_i"].append(-1)
                out["_c"].append(k)
                out["_s"].append([t[0], w[own].sum(), float((w[own] * (t[own] - t[0]).astype(np.longdouble)).sum())])
            if lines.intervals:
                at, basis = lines.place(t)
                by = np.lexsort((c, at))
                new = np.append(True, (np.diff(at[by]) != 0) | (np.diff(c[by]) != 0))
                out["_i"] += at[by[new]].tolist()
                out["_c"] += c[by[new]].tolist()
                out["_s"] += list(np.add.reduceat((basis * w[:, None])[by], np.flatnonzero(new)))
            same = {name: pa.array([rows.column(name)[0].as_py()] * len(out["_i"]), pa.int32()) for name in ("_part", "_line")}
            rest = {"_i": pa.array(out["_i"], pa.int32()), "_c": pa.array(out["_c"], pa.int32()), "_s": pa.array(out["_s"], pa.list_(pa.float64()))}
            yield pa.record_batch(same | rest)

    return task


def _far_values(lines: _Lines, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each interval number [line, polynomial, cluster], flat: the coefficients of the sums of distances to the rows on all other lines; ``weights`` is [line, node, cluster]."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, clusters, places, turn = len(lines.others), weights.shape[2], lines.nodes, _turn()
        values, which = np.unique(_apart(lines.others), return_inverse=True)
        which = which.ravel()
        by = np.argsort(which, kind="stable")
        pairs = [np.divmod(g, count) for g in np.split(by, np.flatnonzero(np.diff(which[by])) + 1)]
        for batch in batches:
            for i in batch.column("id").to_pylist():
                out = np.zeros((count, DEGREE, clusters))
                gap = np.subtract.outer(places[i * DEGREE : (i + 1) * DEGREE], places) ** 2
                for value, (to, of) in zip(values, pairs, strict=True):
                    if value > 0:
                        d = np.sqrt(gap + value * value)
                        for a, b in zip(to.tolist(), of.tolist(), strict=True):
                            out[a] += d @ weights[b]
                yield pa.record_batch({"_i": pa.array([i], pa.int32()), "_s": pa.array([np.einsum("jk,ljc->lkc", turn, out).ravel()], pa.list_(pa.float64()))})

    return task


def _line_silhouettes(lines: _Lines, names: np.ndarray, sizes: np.ndarray, parts: dict[int, tuple], far: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_c, _x, silhouette) of points in order. ``parts``: for each line numbers, first places, rows [part, cluster] and distances of its parts; ``far`` is [line, interval, polynomial, cluster]."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _segments(batches):
            line, part = rows.column("_line")[0].as_py(), rows.column("_part")[0].as_py()
            t, w = rows.column("_t").to_numpy(), rows.column("_w").to_numpy().astype(float)
            c = np.searchsorted(names, rows.column("_c").to_numpy())
            z, order = (t - t[0]).astype(np.longdouble), np.arange(len(t))
            at, basis = lines.place(t) if far is not None else (None, None)
            number, first, count, away = parts[line]
            left, right = number < part, number > part
            a, b = np.zeros(len(t)), np.full(len(t), np.inf)
            for k in range(len(names)):
                own = np.flatnonzero(c == k)
                # Distances on the line itself: sums of the rows before and after each point.
                n, s = (np.append(0, np.cumsum(v)) for v in (w[own].astype(np.longdouble), w[own] * z[own]))
                before = np.searchsorted(own, order, side="right")
                d = (z * n[before] - s[before]) + ((s[-1] - s[before]) - z * (n[-1] - n[before]))
                for q in np.flatnonzero((left | right) & (count[:, k] > 0)):
                    d += (1 if left[q] else -1) * (count[q, k] * (t - first[q]) - away[q, k])
                d = d.astype(float)
                if far is not None:
                    d += np.einsum("ij,ij->i", basis, far[line, at, :, k])
                inside = c == k
                a[inside] = d[inside] / max(sizes[k] - 1, 1)
                b[~inside] = np.minimum(b[~inside], d[~inside] / sizes[k])
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where((sizes[c] == 1) | (most == 0), 0.0, (b - a) / most)
            yield pa.record_batch({"_c": rows.column("_c").combine_chunks(), "_x": rows.column("_x").combine_chunks(), "silhouette": pa.array(value, mask=np.isinf(b))})

    return task


def _by_lines(points: DataFrame, lines: _Lines, sizes: dict[int, int], n: int) -> DataFrame:
    """(_c, _x, silhouette) of points on few lines: each line's points in order, sums before and after them, and for other lines
    polynomials by interval. The lines' numbers (nodes by clusters) pass through the driver, points do not."""
    spark, count, clusters = points.sparkSession, len(lines.others), len(sizes)
    names = np.array(sorted(sizes))
    rest = F.array(*[F.col("_x")[k] for k in range(lines.others.shape[1] + 1) if k != lines.along])
    if count > 1:
        numbers = spark.createDataFrame([(i, r) for i, r in enumerate(lines.others.tolist())], "_line int, _rest array<double>")
        placed = points.withColumn("_rest", rest).join(F.broadcast(numbers), "_rest")
    else:
        placed = points.withColumn("_line", F.lit(0))
    placed = placed.withColumn("_t", F.col("_x")[lines.along]).select("_line", "_t", "_c", "_x", "_w")
    ordered = placed.repartitionByRange(max(1, -(-n // HELD)), "_line", "_t").sortWithinPartitions("_line", "_t")
    ordered = cut_lineage(ordered.withColumn("_part", F.spark_partition_id()))
    sums = ordered.mapInArrow(_line_sums(lines, names), "_part int, _line int, _i int, _c int, _s array<double>").toArrow()
    part, line, at, c = (sums.column(k).to_numpy() for k in ("_part", "_line", "_i", "_c"))
    held = sums.column("_s").combine_chunks()
    whole = np.flatnonzero(at < 0)
    parts = {}
    for one in range(count):
        own = whole[line[whole] == one]
        number, place = np.unique(part[own], return_inverse=True)
        found = held.take(pa.array(own)).flatten().to_numpy().reshape(-1, 3)
        first, rows, away = np.zeros(len(number)), np.zeros((len(number), clusters)), np.zeros((len(number), clusters))
        first[place], rows[place, c[own]], away[place, c[own]] = found.T
        parts[one] = (number, first, rows, away)
    far = None
    if lines.intervals:
        moments, own = np.zeros((count, lines.intervals, clusters, DEGREE)), np.flatnonzero(at >= 0)
        np.add.at(moments, (line[own], at[own], c[own]), held.take(pa.array(own)).flatten().to_numpy().reshape(-1, DEGREE))
        weights = np.einsum("jk,lick->lijc", _turn(), moments).reshape(count, -1, clusters)
        steps = spark.range(0, lines.intervals, 1, min(lines.intervals, 2000))
        met = steps.mapInArrow(_far_values(lines, weights), "_i int, _s array<double>").toArrow()
        far = np.zeros((count, lines.intervals, DEGREE, clusters))
        far[:, met.column("_i").to_numpy()] = met.column("_s").combine_chunks().flatten().to_numpy().reshape(-1, count, DEGREE, clusters).transpose(1, 0, 2, 3)
    number = np.array([sizes[k] for k in names.tolist()])
    return ordered.mapInArrow(_line_silhouettes(lines, names, number, parts, far), "_c bigint, _x array<double>, silhouette double")


def silhouettes(df: DataFrame, columns: Sequence[str], cluster: str, key: str, block: int | None = None) -> DataFrame:
    """(key, cluster, silhouette) by Euclidean distances: (b - a) / max(a, b), a the mean distance to the own cluster's other rows, b to the next cluster.

    Rows of a cluster that are alike in all columns are one point. Points in one column, or on few lines (all columns but one have few combinations of values),
    are sorted along them, which gives their sums of distances without pairs, exact but for rounding (``_by_lines``). Otherwise, or with ``block`` given,
    all pairs of points are needed, but none is shuffled: blocks of about ``block`` points meet two by two, once, and
    send a sum for each of their points and each cluster of the other block. A row alone in its cluster, or with no distance to
    any row, has 0; with one cluster only it is null. ``key`` is unique; rows with a null in a column or no cluster are left out.
    """
    rows = df.dropna(subset=[*columns, cluster])
    sizes = cut_lineage(rows.groupBy(F.col(cluster).alias("_name")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_c", F.monotonically_increasing_id()))
    clusters = sizes.count()
    few = clusters <= FEW
    # Join keys make numbers of the clusters' names, which may be of any type.
    placed = rows.select(F.col(key).alias("_key"), F.col(cluster).alias("_name"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    placed = placed.join(F.broadcast(sizes) if few else sizes, "_name").select("_key", "_c", "_x")
    points = cut_lineage(placed.groupBy("_c", "_x").agg(F.count(F.lit(1)).alias("_w")).withColumn("_id", F.monotonically_increasing_id()))
    n = points.count()
    lines = None if block or not n else _find_lines(points, len(columns), n, clusters)
    if lines:
        found = _by_lines(points, lines, {r["_c"]: r["_n"] for r in sizes.collect()}, n).join(F.broadcast(sizes.select("_c", "_name")), "_c")
    else:
        found = _by_pairs(points, sizes, few, n, block)
    return placed.join(found, ["_c", "_x"]).select(F.col("_key").alias(key), F.col("_name").alias(cluster), "silhouette")


def _by_pairs(points: DataFrame, sizes: DataFrame, few: bool, n: int, block: int | None) -> DataFrame:
    """(_c, _x, _name, silhouette) of points, from blocks that meet two by two."""
    blocks = max(1, -(-n // (block or min(WIDEST, max(BLOCK, n // BLOCKS)))))
    dealt = points.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).select("_id", "_c", "_x", "_w", "_block")
    left = dealt.withColumns({"_a": F.col("_block"), "_b": F.explode(F.sequence(F.col("_block"), F.lit(blocks - 1)))})
    right = dealt.withColumns({"_a": F.explode(F.sequence(F.lit(0), F.col("_block"))), "_b": F.col("_block")})
    # A task for each pair of blocks, or nearly: pairs take long and have few bytes.
    tasks = min(2000, blocks * (blocks + 1) // 2)
    pair = lambda side: side.repartition(tasks, "_a", "_b").groupBy("_a", "_b")
    met = pair(left).cogroup(pair(right)).applyInArrow(_distance_sums, "_id bigint, _c bigint, _s double")
    sums = met.groupBy("_id", "_c").agg(F.sum("_s").alias("_s"))
    own = points.select("_id", F.col("_c").alias("_own"))
    each = sums.join(own, "_id").join(F.broadcast(sizes) if few else sizes, "_c")
    inside = F.col("_c") == F.col("_own")
    a = F.max(F.when(inside, F.try_divide(F.col("_s"), F.col("_n") - 1)))
    b = F.min(F.when(~inside, F.col("_s") / F.col("_n")))
    got = each.groupBy("_id").agg(a.alias("a"), b.alias("b"), F.max(F.when(inside, F.col("_n"))).alias("n"), F.max(F.when(inside, F.col("_name"))).alias("_name"))
    value = F.when(F.col("b").isNull(), None).when((F.col("n") == 1) | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return got.select("_id", "_name", value.alias("silhouette")).join(points.select("_id", "_c", "_x"), "_id").drop("_id")


def squared_silhouettes(df: DataFrame, columns: Sequence[str], cluster: str, key: str) -> DataFrame:
    """(key, cluster, silhouette) by squared distances, an approximation in one pass: they need each cluster's moments only: no pairs of rows.

    The mean squared distance from x to a cluster is |x|^2 - 2 x.mean + mean(|y|^2).
    """
    sizes = df.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in columns], F.avg(total([F.col(c) * F.col(c) for c in columns])).alias("_s"))
    # A row per cluster: broadcast if there are few, else the planner decides.
    each = df.select(key, cluster, *columns).crossJoin(F.broadcast(sizes) if sizes.count() <= FEW else sizes)
    d = total([F.col(c) * F.col(c) for c in columns]) - 2 * total([F.col(c) * F.col(f"_m_{c}") for c in columns]) + F.col("_s")
    own = F.col(cluster) == F.col("_c")
    d = F.when(own, F.try_divide(d * F.col("_n"), F.col("_n") - 1)).otherwise(d)
    got = each.groupBy(key, cluster).agg(F.max(F.when(own, d)).alias("a"), F.min(F.when(~own, d)).alias("b"), F.max(F.when(own, F.col("_n"))).alias("n"))
    return got.select(key, cluster, F.when(F.col("n") == 1, 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"))
