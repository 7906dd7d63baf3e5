"""Hard-negative mining by a distributed kNN join over a Voronoi partition.

The largest inner product with an anchor becomes the nearest neighbour by one more
component: a row x gets sqrt(M - |x|^2), M the largest squared norm, and an anchor q gets 0, so that
|q' - x'|^2 = |q|^2 + M - 2 q.x. Rows belong to the cell of their nearest pivot. By the triangle
inequality the distances of an anchor to a cell's pivot, and of the cell's rows to it, bound
every score that the cell can give. An anchor first meets the rows of its own cell, which gives it a
least score; then a cell's rows are replicated to those anchor groups only in which
some anchor's bounds say that the cell might serve it. Groups and cells meet in
bounded parts, joined exactly in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import release, stored

#: Pivots at most; rows that they are taken from.
PIVOTS, SAMPLE = 64, 512
#: Anchors of a group and rows of a cell that meet in a task, about.
ANCHORS, CHUNK = 256, 8192
LEAST, MOST = -(1 << 62), 1 << 62


def quantised(vectors: DataFrame, key: str, label: str, vector: str, steps: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(steps * x) of each component; rows with a null or a component that is null or not finite go.

    Shorter vectors are filled with zeros, so all have the length of the longest.
    """
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    x = F.transform(F.col(vector), lambda e: F.floor(steps * e.cast("double")).cast("bigint"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(F.forall(vector, fine))
    rows = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), x.alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v"))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@dataclass(frozen=True)
class Space:
    """Pivots (with their further component), M, and for each cell its number of rows and their least and largest distance."""

    pivots: np.ndarray
    most: float
    count: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def gaps(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Distances of points (with further component ``extra``) to all pivots."""
        norm = (x * x).sum(1) + extra**2
        d = norm[:, None] + (self.pivots**2).sum(1)[None] - 2 * (x @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[None, :, -1])
        return np.sqrt(np.maximum(d, 0))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score of each anchor with each cell's rows, rounding allowed for."""
        d = self.gaps(q, np.zeros(len(q)))
        ceiling = (q * q).sum(1)[:, None] + self.most
        slack = 1 + 1e-7 * ceiling
        least = np.maximum(0, np.maximum(d - self.far[None], self.near[None] - d))
        return (ceiling - (d + self.far[None]) ** 2) / 2 - slack, (ceiling - least**2) / 2 + slack


def voronoi(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, Space]:
    """``rows`` with ``cell``, and the space: pivots are taken from SAMPLE rows, the same in every run."""
    most = float(rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).first()[0])
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    points = np.array(list(dict.fromkeys(tuple(r["v"]) for r in sample))[:pivots], float)
    extra = np.sqrt(np.maximum(most - (points**2).sum(1), 0))
    space = Space(np.column_stack([points, extra]), most, *(np.zeros(len(points)) for _ in range(3)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v")).astype(float)
            d = space.gaps(x, np.sqrt(np.maximum(space.most - (x * x).sum(1), 0)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "gap"])

    placed = stored(rows.mapInArrow(assign, f"{_kinds(rows)}, cell int, gap double"), "voronoi-rows")
    count, near, far = np.zeros(len(points)), np.zeros(len(points)), np.zeros(len(points))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("a"), F.max("gap").alias("b")).collect():  # a row a pivot
        count[r["cell"]], near[r["cell"]], far[r["cell"]] = r["n"], r["a"], r["b"]
    return placed.drop("gap"), Space(space.pivots, most, count, near, far)


def _grouped(anchors: DataFrame, space: Space, size: int) -> DataFrame:
    """``anchors`` (a, v, ...) with ``home``, the cell whose pivot is nearest, and ``team``, the group: near anchors, about ``size``."""
    teams = max(1, min(len(space.pivots), -(-anchors.count() // size)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column("v")).astype(float)
                d = space.gaps(q, np.zeros(len(q)))
                home = np.where(space.count > 0, d, np.inf).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(d[:, :teams].argmin(1).astype(np.int32))], [*batch.schema.names, "home", "team"])

    placed = stored(anchors.mapInArrow(task, f"{_kinds(anchors)}, home int, team int"), "anchors")
    sizes = {r["team"]: r["n"] for r in placed.groupBy("team").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.element_at(F.array(*[F.lit(-(-sizes.get(t, 1) // size)) for t in range(teams)]), F.col("team") + 1)
    return placed.withColumn("part", F.pmod(F.col("a"), parts).cast("int"))


def _served(space: Space):
    """Each anchor with the cells that might hold a row in one of its windows, its own cell apart."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = space.bounds(_matrix(batch.column("v")).astype(float))
            windows, home = batch.column("windows").to_pylist(), batch.column("home").to_pylist()
            cells = []
            for i, own in enumerate(windows):
                asked = np.zeros(len(space.pivots), bool)
                for w in own:
                    if w["lo"] <= w["hi"]:
                        asked |= (high[i] >= w["lo"]) & (low[i] <= w["hi"])
                asked[home[i]] = False
                cells.append(np.flatnonzero(asked & (space.count > 0)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return task


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, through floats as long as these hold them."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(float) @ x.T.astype(float)).astype(np.int64) if top < 2**53 else q @ x.T


def _meet(k: int, same: bool):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            scores = _scores(_matrix(left.column("v")), _matrix(right.column("v")))
            ids, labels = right.column("vec_id").to_numpy(), right.column("label").to_numpy()
            for i, r in enumerate(left.select(["a", "vec_id", "label", "windows"]).to_pylist()):
                fits = ((labels == r["label"]) == same) & (ids != r["vec_id"])
                for w in r["windows"]:
                    at = np.flatnonzero(fits & (scores[i] >= w["lo"]) & (scores[i] <= w["hi"]))
                    if len(at) > k:
                        at = at[scores[i, at] >= np.partition(scores[i, at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
                    out += [(r["a"], w["w"], int(ids[x]), int(scores[i, x])) for x in at]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("a", "w", "id", "score"), columns, kinds, strict=True)})

    return join


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _join(anchors: DataFrame, rows: DataFrame, space: Space, k: int, same: bool, chunk: int) -> DataFrame:
    """(a, w, id, score): the best of each window among the rows of the anchors' ``cells``, part by part."""
    parts = F.array(*[F.lit(max(1, int(-(-n // chunk)))) for n in space.count])
    number = lambda cell: F.element_at(parts, cell + 1)
    unit = ["team", "part", "cell", "chunk"]
    asking = anchors.withColumn("cell", F.explode("cells")).withColumn("chunk", F.explode(F.sequence(F.lit(0), number(F.col("cell")) - 1)))
    asking = asking.select(*unit, "a", "vec_id", "label", "v", "windows")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), number(F.col("cell"))).cast("int"))
    copies = dealt.join(asking.select(*unit).distinct(), ["cell", "chunk"]).select(*unit, "vec_id", "label", "v").toDF(*unit, "vec_id", "label", "v")
    return asking.groupBy(*unit).cogroup(copies.groupBy(*unit)).applyInArrow(_meet(k, same), "a bigint, w int, id bigint, score bigint")


def nearest(anchors: DataFrame, rows: DataFrame, space: Space, k: int, same: bool, chunk: int = CHUNK) -> DataFrame:
    """(a, w, rank, id, score): for each window of each anchor its ``k`` best rows, of the anchor's label or of all others.

    ``anchors`` come from ``_grouped`` and have ``windows`` (w, lo, hi): bounds of the score, both included. Higher scores
    come first, ties by the smaller id; rows with the anchor's vec_id are left out. Exact.
    """
    first = stored(_best(_join(anchors.withColumn("cells", F.array("home")), rows, space, k, same, chunk), k), "nearest-home")
    floor = first.where(F.col("rank") == k).select("a", "w", F.col("score").alias("floor"))
    raised = anchors.select("a", F.explode("windows").alias("x")).select("a", "x.*").join(floor, ["a", "w"], "left")
    raised = raised.groupBy("a").agg(F.collect_list(F.struct("w", F.greatest("lo", "floor").alias("lo"), "hi")).alias("windows"))  # as many as before
    asked = anchors.drop("windows").join(raised, "a")
    asked = stored(asked.mapInArrow(_served(space), f"{_kinds(asked)}, cells array<int>"), "nearest-asked")
    second = _join(asked, rows, space, k, same, chunk)
    return stored(_best(first.select("a", "w", "id", "score").union(second), k), "nearest")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, anchors_each: int = ANCHORS, chunk: int = CHUNK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, v) as from ``quantised``.

    For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` per cent of the positive's. Each of several rows with a vec_id takes part, except
    with the anchors of that id; equal anchor rows are one anchor. Without anchors, positives or negatives there are no rows; an
    empty table gives an empty result. Scores are exact as long as they are 64-bit numbers. Further columns are not read.
    """
    rows = stored(rows.select("vec_id", "label", "v"), "vectors")
    if rows.isEmpty():
        kind = "bigint"
        return rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score {kind}, negative_score {kind}")
    placed, space = voronoi(rows, pivots)
    anchors = _grouped(rows.where(is_anchor).distinct().withColumn("a", F.xxhash64("vec_id", "label", "v")), space, anchors_each)
    release(rows)
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi")))
    best = nearest(anchors.withColumn("windows", whole), placed, space, positives, True, chunk)
    best = best.select("a", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    percent = lambda p, up: F.expr(f"(positive_score * {p} {f'+ pmod(-positive_score * {p}, 100)' if up else f'- pmod(positive_score * {p}, 100)'}) div 100")
    windows = best.groupBy("a").agg(F.collect_list(F.struct("w", percent(low, True).alias("lo"), percent(high, False).alias("hi"))).alias("windows"))  # ``positives`` entries
    hard = nearest(anchors.join(windows, "a"), placed, space, negatives, False, chunk)
    hard = hard.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("a", F.col("vec_id").alias("anchor_id"))
    return hard.join(best, ["a", "w"]).join(named, "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector; labels of every seventh are moved on by one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(table.select("vec_id", moved.alias("label"), "embedding"), "vec_id", "label", "embedding")
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE = {
    "op12_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id AS id, list_dot_product(a.v, e.v)::BIGINT AS score FROM a JOIN e ON a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, k ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND k <= 5 AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
}
