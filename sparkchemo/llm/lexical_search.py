"""Ranked lexical search with dual-sorted wavelet trees.

Documents are cut into shards. A shard's postings stand in one sequence of local document
numbers: term after term, within a term by falling impact. A wavelet tree over the sequence
navigates it by document number as well: a node is a range of documents, and the postings of
a term in it are a range of the node's sequence, still by falling impact, so the first of them
bounds what the term can give to any document below. For each item the nodes with the
best sums of bounds are opened first; a leaf is a document, and its sum is its score. Nodes that
cannot reach the best so far stay closed, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import UPPER, LOWER, stored
from sparkchemo.llm.textkit import Words, slices, texts

#: Bytes that end a term: all ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x41:0x5B] = GAP[0x61:0x7B] = GAP[0x80:] = False
#: Documents and postings of a shard at most (one document may have more postings).
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Nodes of an item that are opened in a round, and different terms that the items of a block have, about.
BEAM, BLOCK_TERMS = 16, 1 << 17
SLICE = 2 << 20
TOP = 20


class WaveletTree:
    """A shard's postings: range ``first[t]`` to ``first[t + 1]`` of the root's sequence is term t, by falling impact.

    Each level keeps, in the order of its nodes, how many of the entries before a place go to the
    left child, and the impacts; a level's left children come first.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((doc, -impact, term))
        doc, impact = doc[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.depth = max(1, int(n_docs - 1).bit_length()) if n_docs else 1
        self.left, self.impact = [], [impact.astype(np.int32)]
        for level in range(self.depth):
            right = (doc >> (self.depth - 1 - level)) & 1 == 1
            self.left.append(np.concatenate([[0], np.cumsum(~right)]).astype(np.int32))
            doc, impact = np.concatenate([doc[~right], doc[right]]), np.concatenate([impact[~right], impact[right]])
            self.impact.append(impact.astype(np.int32))

    def children(self, level: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of a level's sequence in the left and in the right children's."""
        left = self.left[level]
        a, b = left[begin], left[end]
        return a, b, left[-1] + begin - a, left[-1] + end - b


@dataclass(frozen=True)
class Items:
    """The items of a block: their ids, and (item, term, weight) sorted by item; a weight has the repeats in it."""

    ids: list
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray


class Best:
    """The ``top`` best (score, doc_id) of each item so far; the smaller doc_id wins ties."""

    def __init__(self, n: int, top: int):
        self.top, self.least = top, np.ones(n, np.int64)
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.top
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = place == self.top - 1
        self.least[item[full]] = np.maximum(score[full], 1)


def search(tree: WaveletTree, items: Items, best: Best, ids: np.ndarray, beam: int = BEAM) -> int:
    """Adds the shard's best documents of each item to ``best``; returns how many nodes were opened.

    All items go on together: in a round each opens its ``beam`` best nodes. A node is a row of (item, level, value, bound) with
    a stretch of (weight, begin, end) by term.
    """
    begin, end = tree.first[items.term], tree.first[items.term + 1]
    has = end > begin
    item, weight, begin, end = items.item[has], items.weight[has], begin[has], end[has]
    # Nodes: item, level, value, bound; their terms are entries ``edge[k]`` to ``edge[k + 1]``.
    own = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    bound = np.add.reduceat(weight * tree.impact[0][begin], own) if len(own) else np.zeros(0, np.int64)
    nodes = np.stack([item[own], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), bound], 1)
    edge = np.append(own, len(item)).astype(np.int64)
    opened = 0
    while len(nodes):
        # The beam best of each item are opened, the others wait.
        order = np.lexsort((-nodes[:, 1], -nodes[:, 3], nodes[:, 0]))
        place = np.empty(len(nodes), np.int64)
        sorted_items = nodes[order, 0]
        place[order] = np.arange(len(nodes)) - np.searchsorted(sorted_items, sorted_items)
        now = place < beam
        opened += int(now.sum())
        entry = np.repeat(now, np.diff(edge))
        at = np.repeat(np.cumsum(now) - 1, np.diff(edge))[entry]
        w, b, e, parents = weight[entry], begin[entry], end[entry], nodes[now]
        made_nodes, made = [], []
        for level in np.unique(parents[:, 1]).tolist():
            own = parents[at, 1] == level
            a0, b0, a1, b1 = tree.children(level, b[own], e[own])
            for bit, x, y in ((0, a0, b0), (1, a1, b1)):
                full = y > x
                who, ww, x, y = at[own][full], w[own][full], x[full], y[full]
                if not len(who):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                bound = np.add.reduceat(ww * tree.impact[level + 1][x], cut)
                up = parents[who[cut]]
                child = np.stack([up[:, 0], np.full(len(cut), level + 1), 2 * up[:, 2] + bit, bound], 1)
                if level + 1 == tree.depth:  # a document: its bound is its score
                    best.add(child[:, 0], bound, ids[child[:, 2]])
                    continue
                good = bound >= best.least[child[:, 0]]
                inner = np.repeat(good, np.diff(np.append(cut, len(who))))
                made_nodes.append(child[good])
                made.append((np.diff(np.append(cut, len(who)))[good], ww[inner], x[inner], y[inner]))
        waits = ~now & (nodes[:, 3] >= best.least[nodes[:, 0]])
        rest = np.repeat(waits, np.diff(edge))
        sizes = np.concatenate([np.diff(edge)[waits], *(m[0] for m in made)])
        weight, begin, end = (np.concatenate([x[rest], *(m[k] for m in made)]) for k, x in ((1, weight), (2, begin), (3, end)))
        nodes = np.concatenate([nodes[waits], *made_nodes])
        edge = np.concatenate([[0], np.cumsum(sizes)])
    return opened


def _postings(keys: np.ndarray):
    """(doc_id, n, terms, counts): how many terms each text has, and how often those of the sorted ``keys``; a row with null doc_id counts as well."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for i, j in slices(offsets, SLICE):
                w = Words(data, offsets, i, j, gap=GAP)
                h = w.hashes()
                at = np.searchsorted(keys, h)
                known = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.zeros(0, np.int64)
                row = np.searchsorted(w.first, known, "right") - 1
                pair, n = np.unique(row * len(keys) + at[known], return_counts=True)
                row = pair // max(1, len(keys))
                lists = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x)) for x in ((pair % max(1, len(keys))).astype(np.int32), n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(w.first)), *columns], ["doc_id", "n", "terms", "counts"])

    return task


def _rank(items: Items, n_terms: int, documents: int, terms: int, top: int, shard_docs: int, beam: int):
    """The ``top`` best documents of each item among a task's, shard after shard; earlier shards' results close nodes of later ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), top)
        held: list[pa.RecordBatch] = []

        def build() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = table.column("terms").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(size)), size)
            tf, n = table.column("counts").combine_chunks().flatten().to_numpy(), table.column("n").to_numpy()
            m = 100 - 25 + (25 * n * documents) // terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            tree = WaveletTree(lists.flatten().to_numpy().astype(np.int64), doc, impact, n_terms, len(size))
            search(tree, items, best, table.column("doc_id").to_numpy(), beam)

        docs = posted = 0
        for batch in batches:
            done = 0
            ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            while done < batch.num_rows:
                before = int(ends[done - 1]) if done else 0
                fit = int(np.searchsorted(ends, before + SHARD_POSTINGS - posted, "right"))
                upto = min(batch.num_rows, done + shard_docs - docs, max(fit, done + (not held)))
                if upto > done:
                    held.append(batch.slice(done, upto - done))
                    docs, posted, done = docs + upto - done, posted + int(ends[upto - 1]) - before, upto
                if done < batch.num_rows:
                    build()
                    docs = posted = 0
        if held:
            build()
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc), pa.array(best.score)], ["item", "doc_id", "score"])

    return task


def _hash_terms(text: list) -> np.ndarray:
    data = [x.encode() for x in text]
    w = Words(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), 0, len(data), gap=GAP)
    return w.hashes()


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, shard_docs: int = SHARD_DOCS, beam: int = BEAM, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item, scores above 0 only, ties by doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. The score sums, over the item's terms with
    their repeats, a weight that falls with the documents holding the term times a saturating share of its occurrences,
    in integers. Terms are ASCII digits and letters and all other characters beyond ASCII, A-Z lower-cased, met by 64-bit
    hashes. Items go in blocks of about ``block_terms`` different terms: a block is held by each task, and each block
    reads the documents once. Null and empty texts have no terms. Each of several rows of ``docs`` with a doc_id is a
    document; a null doc_id is counted but not returned. Equal rows of ``items`` are one item, and rows that share
    an item_id one item of all their terms. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")
    asked = items.distinct().select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))
    asked = stored(asked, "search-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        own = asked.where(F.col("block") == block).collect()  # about ``block_terms`` rows
        names = sorted({r["term"] for r in own})
        hashed = _hash_terms([x + " " for x in names]) if names else np.zeros(0, np.uint64)
        order = np.argsort(hashed)
        keys = hashed[order]
        place = {names[k]: i for i, k in enumerate(order.tolist())}
        postings = stored(rows.mapInArrow(_postings(keys), "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"), "search-postings")
        total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r["t"]: r["df"] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term of the block
        weight = {t: math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * n + 1))) for t, n in df.items()}
        ids = list(dict.fromkeys(r["item_id"] for r in own))
        number = {x: k for k, x in enumerate(ids)}
        entries = sorted((number[r["item_id"]], place[r["term"]], r["n"] * weight[place[r["term"]]]) for r in own if weight.get(place[r["term"]], 0) > 0)
        entries = np.array(entries, np.int64).reshape(-1, 3)
        held = Items(ids, entries[:, 0], entries[:, 1], entries[:, 2])
        score = _rank(held, len(keys), total["documents"], max(1, total["terms"]), top, shard_docs, beam)
        got = postings.where("n > 0 and doc_id is not null").mapInArrow(score, "item bigint, doc_id bigint, score bigint")
        named = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        place_ = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        got = got.withColumn("rank", place_).where(F.col("rank") <= top).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        found = got if found is None else found.union(got)
    return found


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_TERMS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = {
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, unnest({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM i) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, c GROUP BY t),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM i JOIN f USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""
}
