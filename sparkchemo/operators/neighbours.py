"""An exact nearest-neighbour join: boxes of a tree over a sample, and in each box a search of small leaves.

Points and queries of a box meet in one task, and a query's k-th distance there says how far it has to look: it goes on only to
those boxes whose region is as near. Boxes grow in number with the points, queries of a crowded box are dealt to several tasks, and
of a place that very many points share only those go on that can be a neighbour. So no task holds more than
a bounded part, a query meets a few leaves, and only queries near the border of their box are shuffled again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.functions.lineage import cut_lineage

#: Points of a box, boxes at most, and sampled rows for each.
BOX, BOXES, EACH = 16384, 8192, 32
#: Queries of a task beyond which a box has several, and points beyond which a place is crowded.
PART = 16384
#: Points of a leaf in a box, and queries that meet points at once.
LEAF, CHUNK = 128, 256


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, summed column by column."""
    d = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        g = a[:, None] - b[None]
        g *= g
        d += g
    return d


def _outside(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of boxes; summed as those of rows are, so rounding never makes them larger than a row's."""
    d = np.zeros(max(np.shape(low)[0] if np.ndim(low) > 1 else 1, len(lows)))
    for j in range(lows.shape[1]):
        d += np.maximum(np.maximum(lows[:, j] - high[..., j], low[..., j] - highs[:, j]), 0) ** 2
    return d


class _Tree:
    """Halves of rows by their widest column, cut between values, down to ``size`` rows; a leaf's number is -1 - node."""

    def __init__(self, x: np.ndarray, size: int):
        self.column, self.cut, self.child, self.rows = [], [], [], []
        low, high, todo = [], [], [(np.arange(len(x)), np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf), -1, 0)]
        while todo:
            rows, a, b, parent, side = todo.pop()
            found = self._halve(x[rows], size)
            node = len(self.column) if found else -1 - len(self.rows)
            if parent >= 0:
                self.child[parent][side] = node
            if not found:
                self.rows.append(rows)
                low.append(a)
                high.append(b)
                continue
            j, cut = found
            self.column.append(j)
            self.cut.append(cut)
            self.child.append([0, 0])
            right = x[rows, j] > cut
            a2, b2 = a.copy(), b.copy()
            a2[j] = b2[j] = cut
            todo += [(rows[~right], a, b2, node, 0), (rows[right], a2, b, node, 1)]
        self.low, self.high = np.array(low), np.array(high)
        self.column, self.cut, self.child = np.array(self.column, int), np.array(self.cut, float), np.array(self.child, int).reshape(-1, 2)

    @staticmethod
    def _halve(x: np.ndarray, size: int) -> tuple[int, float] | None:
        if len(x) <= size:
            return None
        with np.errstate(invalid="ignore", over="ignore"):
            wide = np.nan_to_num(x.std(0), nan=np.inf)
        for j in np.argsort(-wide, kind="stable"):
            v = np.sort(x[:, j])
            steps = np.flatnonzero(v[1:] > v[:-1])
            if len(steps):
                at = steps[np.abs(steps + 1 - len(v) / 2).argmin()]
                with np.errstate(invalid="ignore"):
                    cut = v[at] / 2 + v[at + 1] / 2
                return int(j), float(cut if v[at] <= cut < v[at + 1] else v[at])
        return None

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.full(len(x), 0 if len(self.column) else -1)
        at = np.flatnonzero(node >= 0)
        while len(at):
            on = node[at]
            node[at] = self.child[on, (x[at, self.column[on]] > self.cut[on]).astype(int)]
            at = at[node[at] >= 0]
        return -1 - node

    def reach(self, x: np.ndarray, limit: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf wherever a leaf's region, other than ``home``, is within the row's limit."""
        if not len(x):  # a label that has points in a box need not have queries there
            return np.zeros(0, int), np.zeros(0, int)
        rows, leaves, todo = [], [], [(0 if len(self.column) else -1, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf = -1 - node
                at = at[~(_outside(x[at], x[at], self.low[leaf : leaf + 1], self.high[leaf : leaf + 1]) > limit[at])] if leaf != home and len(at) else at[:0]
                rows.append(at)
                leaves.append(np.full(len(at), leaf))
            elif len(at):
                gap = x[at, self.column[node]] - self.cut[node]
                far = gap * gap > limit[at]
                todo += [(self.child[node, 0], at[~(far & (gap > 0))]), (self.child[node, 1], at[~(far & (gap < 0))])]
        return np.concatenate(rows), np.concatenate(leaves)


def _position(new: np.ndarray) -> np.ndarray:
    """Places in runs, from 0; ``new`` says where one begins."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _useful(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that share their place with so many smaller keys that no query takes them."""
    rows = np.lexsort((rank, *x.T))
    for keyed, most in ((True, k), (False, 2 * k)):  # k of a key, so of 2 k rows any query leaves k
        new = np.ones(len(rows), bool)
        new[1:] = (x[rows[1:]] != x[rows[:-1]]).any(1) | (keyed & (rank[rows[1:]] != rank[rows[:-1]]))
        rows = rows[_position(new) < most]
    return rows


def _search(p: np.ndarray, p_rank: np.ndarray, q: np.ndarray, q_rank: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the k nearest points within each query's limit, by query, distance and key."""
    none = np.zeros(0, int)
    if not len(p) or not len(q):
        return none, none, np.zeros(0)
    kept = _useful(p, p_rank, k)
    p, p_rank = p[kept], p_rank[kept]
    tree = _Tree(p, LEAF)
    low, high = (np.array([f(p[r], axis=0) for r in tree.rows]) for f in (np.min, np.max))
    odd = not (np.isfinite(p).all() and np.isfinite(q).all())
    leaf = tree.place(q)
    by = np.argsort(leaf, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(leaf[by])) + 1, len(by))
    found = []

    def distances(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = _gaps(q[at], p[rows])
        if odd:
            d[np.isnan(d)] = np.inf
        d[q_rank[at][:, None] == p_rank[rows][None]] = np.nan
        return d

    def bound(d: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1], limit[at]) if d.shape[1] >= k else limit[at]

    for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
        own = leaf[by[begin]]
        for start in range(begin, end, CHUNK):
            at = by[start : min(end, start + CHUNK)]
            rows = tree.rows[own]
            d = distances(at, rows)
            most = bound(d, at)
            top, a, b = most.max(), q[at].min(0), q[at].max(0)
            near = np.flatnonzero(~(_outside(a, b, low, high) > top))
            near = near[near != own]
            if len(near):
                more = np.concatenate([tree.rows[n] for n in near])
                more = more[~(_outside(a, b, p[more], p[more]) > top)]
                if len(more):
                    d, rows = np.hstack([d, distances(at, more)]), np.append(rows, more)
                    most = bound(d, at)
            i, j = np.nonzero(d <= most[:, None])
            gap = d[i, j]
            order = np.lexsort((p_rank[rows[j]], gap, i))
            i, j, gap = i[order], j[order], gap[order]
            first = _position(np.append(True, np.diff(i) > 0)[: len(i)]) < k
            found.append((at[i[first]], kept[rows[j[first]]], gap[first]))
    query, point, gap = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(query, kind="stable")
    return query[order], point[order], gap[order]


def _by_label(label: pa.Array) -> list[tuple[str | None, np.ndarray]]:
    """The rows of each label."""
    code = label.dictionary_encode(null_encoding="encode")
    index, values = code.indices.to_numpy(), code.dictionary.to_pylist()
    order = np.argsort(index, kind="stable")
    return [(values[index[g[0]]], g) for g in np.split(order, np.flatnonzero(np.diff(index[order])) + 1) if len(g)]


class _Boxes:
    """The numbers of boxes: of a tree over all points, or with ``within`` of one for each frequent label and of zones for the others."""

    def __init__(self, x: np.ndarray, labels: list, boxes: int, within: bool):
        size, self.within, self.trees, self.base, self.zones = max(1, -(-len(x) // boxes)), within, {}, {}, boxes if within else 0
        at: dict = {}
        for i, v in enumerate(labels if within else []):
            at.setdefault(v, []).append(i)
        for v, rows in (at if within else {None: np.arange(len(x))}).items():
            if not within or len(rows) > size:
                self.base[v], self.trees[v] = self.count - self.zones, _Tree(x[rows], size)

    @property
    def count(self) -> int:
        return self.zones + sum(len(t.rows) for t in self.trees.values())

    def place(self, x: np.ndarray, label: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each row's box, and how far the border of the box's region is."""
        box, gap = np.empty(len(x), int), np.zeros(len(x))
        for v, rows in _by_label(label) if self.within else [(None, np.arange(len(x)))]:
            if v in self.trees:
                one, y = self.trees[v], x[rows]
                at = one.place(y)
                with np.errstate(invalid="ignore"):
                    gap[rows] = np.nan_to_num(np.minimum(y - one.low[at], one.high[at] - y).min(1), nan=0, posinf=np.inf)
                box[rows] = self.zones + self.base[v] + at
            else:
                box[rows] = zlib.crc32((v or "").encode()) % self.zones
        return box, gap

    def reach(self, x: np.ndarray, limit: np.ndarray, label: str | None, box: int) -> tuple[np.ndarray, np.ndarray]:
        v = label if self.within else None
        if v not in self.trees:  # a zone holds all points of its labels
            return np.zeros(0, int), np.zeros(0, int)
        rows, leaves = self.trees[v].reach(x, limit, box - self.zones - self.base[v])
        return rows, leaves + self.zones + self.base[v]


def _meet(k: int, boxes: _Boxes, first: bool, places: bool):
    """The k nearest points of a task for each of its queries, and (``first``) the other boxes that the query has to look into."""

    def join(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x, ask, have = _matrix(rows.column("x")), rows.column("ask").to_numpy(), rows.column("have").to_numpy()
        rank = np.asarray(pc.rank(rows.column("id"), tiebreaker="dense"), dtype=np.int64)
        limit, box = rows.column("limit").to_numpy(), rows.column("box")[0].as_py()
        groups = _by_label(rows.column("label").combine_chunks()) if boxes.within else [(None, np.arange(len(x)))]
        asked, sizes, points, gaps, cells, counts = [], [], [], [], [], []
        for label, at in groups:
            p, q = at[have[at]], at[ask[at]]
            if len(np.unique(rank[q])) < len(q):  # a row that occurs twice asks once
                q = np.array(list({(rank[i], rows.column("label")[i].as_py(), *x[i]): i for i in q.tolist()}.values()))
            query, point, gap = _search(x[p], rank[p], x[q], rank[q], limit[q], k)
            n = np.bincount(query, minlength=len(q))
            asked.append(q)
            sizes.append(n)
            points.append(p[point])
            gaps.append(gap)
            if first:
                last = np.full(len(q), np.inf)
                full = n >= k
                last[full] = gap[(np.cumsum(n) - 1)[full]]
                who, to = boxes.reach(x[q], last, label, box)
                cells.append(to[np.argsort(who, kind="stable")])
                counts.append(np.bincount(who, minlength=len(q)))
        asked, sizes, points, gaps = (np.concatenate(c) for c in (asked, sizes, points, gaps))
        more = np.concatenate(counts) if first else sizes
        unused = (more == 0) & first  # of a query that is done, keys and places are needed only if asked for
        take = lambda c, i, no=None: rows.column(c).take(pa.array(i, pa.int64(), mask=no)).combine_chunks()
        offsets = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
        of = {"d": pa.array(gaps), "id": take("id", points, None if places else np.repeat(unused, sizes)), "label": take("label", points)} | ({"x": take("x", points)} if places else {})
        near = pa.ListArray.from_arrays(offsets(sizes), pa.StructArray.from_arrays(list(of.values()), list(of)))
        out = {"q": take("id", asked), "q_label": take("label", asked), "x": take("x", asked, unused), "near": near}
        if first:
            out["cells"] = pa.ListArray.from_arrays(offsets(more), pa.array(np.concatenate(cells), pa.int32()))
        return pa.table(out)

    return join


def nearest(rows: DataFrame, k: int, value: Callable[[Column, Column], Column], within: bool = False, boxes: int | None = None, part: int = PART, places: bool = True) -> DataFrame:
    """(q, q_label, value) of each row of ``rows`` (id, x, label, ask, have) that asks, about the nearest of those that it may have.

    ``value`` works on the list of the neighbours (d and label, with ``places`` id and x too, nearest first) and the row's own label.
    """
    place = ["x", "label"] if within else ["x"]
    n, asking = rows.agg(F.count_if("have"), F.count_if("ask")).first()
    number = boxes or min(BOXES, max(1, -(-n // BOX)))
    share = min(1.0, EACH * number / max(1, n, asking))
    told = rows.select("x", "label", "ask", "have")
    sample = (told if share == 1 else told.sample(share, seed=0)).toArrow()
    x, labels, have = _matrix(sample.column("x")), sample.column("label").to_pylist(), sample.column("have").to_numpy()
    width = x.shape[1] if len(x) else 1
    seen = Counter((tuple(a), v if within else None) for a, v, ok in zip(x.tolist(), labels, have, strict=True) if ok)
    crowds = {c for c, m in seen.items() if m >= 8 and m / share >= part}
    tell = np.array([ok and (tuple(a), v if within else None) not in crowds for a, v, ok in zip(x.tolist(), labels, have, strict=True)], bool)
    tree = _Boxes(x[tell].reshape(-1, width), [v for v, ok in zip(labels, tell, strict=True) if ok], number, within)

    if crowds:
        schema = rows.select(*place).schema
        listed = F.broadcast(rows.sparkSession.createDataFrame([(list(a), v)[: len(place)] for a, v in crowds], schema).withColumnsRenamed({c: f"_{c}" for c in place}).withColumn("crowd", F.lit(True)))
        told = rows.join(listed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place], "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)) & F.col("have"))
        many = told.where("crowd").select(*rows.columns)
        for by, most in (([*place, "id"], k), (place, 2 * k)):  # k of a key, so of 2 k rows any query leaves k
            many = many.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= most).drop("_n")
        rows = told.withColumn("have", F.col("have") & ~F.col("crowd")).select(*rows.columns).where("ask or have").unionByName(many.withColumn("ask", F.lit(False)))

    @F.arrow_udf("struct<box: int, gap: double>")
    def home(x: pa.Array, label: pa.Array) -> pa.Array:
        box, gap = tree.place(_matrix(x), label)
        return pa.StructArray.from_arrays([pa.array(box, pa.int32()), pa.array(gap)], ["box", "gap"])

    # Not deterministic only lest the optimiser works it out once more in a filter.
    at = home.asNondeterministic()("x", F.col("label") if within else F.lit(None).cast("string"))
    placed = rows.withColumn("at", at).select(*rows.columns, "at.box", "at.gap", F.lit(float("inf")).alias("limit"))
    ids = rows.schema["id"].dataType.simpleString()
    kinds = f"q {ids}, q_label string, x array<double>, near array<struct<d: double, id: {ids}, label: string{', x: array<double>' * places}>>"

    def dealt(df: DataFrame, tasks: Column) -> DataFrame:
        """Points once for each task of their box, queries once."""
        df = df.withColumn("_own", F.pmod(F.xxhash64("id", "x"), tasks).cast("int")).withColumn("side", F.explode(F.when(F.col("have"), F.sequence(F.lit(0), tasks.cast("int") - 1)).otherwise(F.array("_own"))))
        return df.withColumn("ask", F.col("ask") & (F.col("side") == F.col("_own"))).drop("_own")

    met = ["box", "side", "id", "x", "label", "ask", "have", "limit"]
    asks = np.bincount(tree.place(x, sample.column("label").combine_chunks())[0][sample.column("ask").to_numpy()], minlength=tree.count) if len(x) else np.zeros(1)
    tasks = np.maximum(1, np.ceil(asks / share / (4 * part))).astype(int)
    if (tasks == 1).all():
        first = placed.withColumn("side", F.lit(0))
    else:  # one text literal, however many boxes there are
        first = dealt(placed, F.element_at(F.split(F.lit(",".join(map(str, tasks.tolist()))), ",").cast("array<int>"), F.col("box") + 1))
    found = first.select(*met).groupBy("box", "side").applyInArrow(_meet(k, tree, True, places), f"{kinds}, cells array<int>")
    on, own = F.size("cells") > 0, value(F.col("near"), F.col("q_label"))
    if tree.count == 1:
        return found.select("q", "q_label", own.alias("value"))
    found = cut_lineage(found.select("q", "q_label", "x", F.when(on, F.col("near")).alias("near"), "cells", F.when(~on, own).alias("value")))
    done, left = found.where(~on).select("q", "q_label", "value"), found.where(on)
    if left.isEmpty():
        return done
    limit = F.when(F.size("near") >= k, F.get(F.col("near"), F.lit(k - 1))["d"]).otherwise(float("inf")).alias("limit")
    sent = left.select(F.col("q").alias("id"), "x", F.col("q_label").alias("label"), F.lit(True).alias("ask"), F.lit(False).alias("have"), limit, F.explode("cells").alias("box"))
    # A row a box: how far queries from outside look into it.
    wanted = F.broadcast(sent.groupBy("box").agg(F.max("limit").alias("far"), F.ceil(F.count(F.lit(1)) / (4 * part)).alias("tasks")))
    within_reach = placed.where("have").withColumn("ask", F.lit(False)).join(wanted, "box").where(F.col("gap") * F.col("gap") <= F.col("far"))
    again = within_reach.drop("gap", "far").unionByName(sent.join(wanted.drop("far"), "box"))
    other = dealt(again, F.col("tasks")).select(*met).groupBy("box", "side").applyInArrow(_meet(k, tree, False, places), kinds)
    lists = left.select("q", "q_label", "x", "near").union(other).groupBy("q", "q_label", "x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return done.union(lists.select("q", "q_label", own.alias("value")))


def rows_of(df: DataFrame, columns: Sequence[str], key: str, label: str | None, ask: bool | Column, have: bool | Column) -> DataFrame:
    """(id, x, label, ask, have) of the rows without a null or NaN in a column or a null key."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    flag = lambda c, name: (c if isinstance(c, Column) else F.lit(c)).alias(name)
    return df.dropna(subset=[key, *columns]).select(F.col(key).alias("id"), x, (F.col(label).cast("string") if label else F.lit("")).alias("label"), flag(ask, "ask"), flag(have, "have"))


def neighbours(
    queries: DataFrame, points: DataFrame, columns: Sequence[str], key: str, k: int, label: str | None = None, within: bool = False, pivots: int | None = None, part: int = PART
) -> DataFrame:
    """(q, q_label, rank, d, id, label, x): the ``k`` nearest of ``points`` to each of ``queries``, exact.

    ``q`` and ``id`` are the keys, ``d`` the squared distance in ``columns``, ``x`` the neighbour's columns. A point with the
    query's key is left out; ties go to the smaller key. ``label`` is carried along as text; with ``within`` only points of the
    query's label count. Rows with a null or NaN in a column, or a null key, take no part. Queries have unique keys.
    ``pivots`` is the number of boxes, for which there is one for each 16,384 points otherwise.
    """
    rows = rows_of(queries, columns, key, label, True, False).union(rows_of(points, columns, key, label, False, True))
    near = nearest(rows, k, lambda near, own: near, within, pivots, part).select("q", "q_label", F.posexplode("value").alias("at", "n"))
    kinds = [F.col("q").cast(queries.schema[key].dataType), F.col("n.id").cast(points.schema[key].dataType)]
    return near.select(kinds[0].alias("q"), "q_label", "n.d", kinds[1].alias("id"), "n.label", "n.x", (F.col("at") + 1).alias("rank"))
