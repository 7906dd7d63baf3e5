"""Language-model scoring: a probabilistic suffix tree over bytes, and a smoothed unigram base.

Training counts every run of DEPTH + 1 bytes of the training texts (numpy in Arrow tasks,
summed by Spark). A context stays in the tree if its next-byte distribution diverges from
that of the context one byte shorter. Distributions are smoothed towards the shorter
context's. The tree is a Spark table that grows with the corpus. A run's log probability
comes from its longest context in the tree: tasks hold those of the commonest runs, and
the other runs of a text meet the tree in joins. ``SuffixTree`` is the same model as an
automaton, for a tree that fits one machine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import fold, stored
from sparkchemo.llm.lockstep import blocks
from sparkchemo.llm.textkit import Words, slices, texts

#: Longest context in bytes (so a run is 48 bits), the byte that ends a text and stands before it.
DEPTH, END = 5, 10
#: A context stays if n * KL(own || shorter) in nats exceeds this, at any size of the corpus.
DIVERGENCE = 8.0
#: Weight of the shorter context's distribution, in observations.
SMOOTHING = 4.0
BLOCK, SLICE = 512, 1 << 19
#: Words whose counts, and runs whose log probabilities, every task holds; the others are looked up by a join.
FREQUENT = 1 << 20
#: Places where a held run is looked for; one that finds them all taken is looked up by the join.
PROBES = 16
#: Different runs or words that a task gathers before it passes them on.
GATHER = 1 << 21


def byte_streams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts with one blank between words and END after the last: (bytes, edges)."""
    size = w.end - w.start
    last = np.zeros(len(size), bool)
    ends = w.first[1:][w.first[1:] > w.first[:-1]] - 1
    last[ends] = True
    words_in = np.diff(w.first)
    # Each word is followed by a blank or, the last of a text, by END; a text without words is END alone.
    place = np.cumsum(size + 1) - (size + 1)
    empty_before = np.cumsum(words_in == 0) - (words_in == 0)
    text = np.repeat(np.arange(len(words_in)), words_in)
    place = place + empty_before[text]
    total = int((size + 1).sum() + (words_in == 0).sum())
    out = np.full(total, END, np.uint8)
    at = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    inner = np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[at] = w.data[inner]
    out[(place + size)[~last]] = 32
    lengths = np.bincount(text, size + 1, len(words_in)).astype(np.int64) + (words_in == 0)
    return out, np.concatenate([[0], np.cumsum(lengths)])


def _runs(stream: np.ndarray, edges: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with the ``depth`` bytes before it in its text as one number, the newest lowest; END stands before a text."""
    code = stream.astype(np.int64)
    n = len(stream)
    since = np.arange(n) - np.repeat(edges[:-1], np.diff(edges))
    for d in range(1, depth + 1):
        back = np.full(n, END, np.int64)
        back[d:] = stream[:-d]
        back[since < d] = END
        code |= back << (8 * d)
    return code


def _count(depth: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            keys, back = np.unique(keys, return_inverse=True)
            return keys, np.bincount(back, counts, len(keys)).astype(np.int64)

        def emit(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, counts = merged(kind)
                held[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])

        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for i, j in slices(offsets, SLICE):
                w = Words(data, offsets, i, j)
                for kind, keys in ((0, w.hashes().view(np.int64)), (1, _runs(*byte_streams(w), depth))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in held[kind]) > GATHER:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > GATHER // 2:
                            yield from emit(kind)
        yield from emit(0)
        yield from emit(1)

    return task


@dataclass(frozen=True)
class SuffixTree:
    """The tree as a table: ``table[state * width + class]`` is the next state times ``width``, ``logp`` the log10 probability.

    Class 0 is every byte that training never saw (its probability is shared by all 256),
    the last class is padding, which changes nothing and costs nothing.
    """

    classes: np.ndarray
    width: int
    start: int
    table: np.ndarray
    logp: np.ndarray
    contexts: int

    @classmethod
    def build(cls, rows: list[tuple[int, int, int, int]], smoothing: float = SMOOTHING) -> SuffixTree:
        """``rows`` (length, context, byte, n): the next-byte counts of every kept context, the empty one included."""
        counts: dict[tuple[int, int], dict[int, int]] = {(0, 0): {}}
        for d, ctx, byte, n in rows:
            counts.setdefault((d, ctx), {})[byte] = n
        used = sorted({b for c in counts.values() for b in c} | {END})
        width = len(used) + 2
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        dist: dict[tuple[int, int], np.ndarray] = {}
        # Root: add-half over all 256 bytes; a byte never seen takes one of the equal shares.
        root = np.full(width, 0.5)
        for b, n in counts[0, 0].items():
            root[classes[b]] += n
        dist[0, 0] = root / (sum(counts[0, 0].values()) + 128.0)
        for d, ctx in sorted(counts):
            if d:
                shorter = next(k for k in ((e, ctx & ((1 << 8 * e) - 1)) for e in range(d - 1, -1, -1)) if k in dist)
                own, total = np.zeros(width), 0
                for b, n in counts[d, ctx].items():
                    own[classes[b]], total = n, total + n
                dist[d, ctx] = (own + smoothing * dist[shorter]) / (total + smoothing)
        # A state for every kept context and every beginning of one, so that the longest one is always reached.
        states = {(0, 0)} | {(e, ctx >> 8 * (d - e)) for d, ctx in dist for e in range(1, d + 1)}
        index = {k: i for i, k in enumerate(sorted(states))}

        def longest(d: int, ctx: int, among) -> tuple[int, int]:
            return next(k for k in ((e, ctx & ((1 << 8 * e) - 1)) for e in range(d, -1, -1)) if k in among)

        depth = max(d for d, _ in states)
        table, logp = np.zeros((len(index), width), np.int32), np.zeros((len(index), width), np.float32)
        for (d, ctx), i in index.items():
            logp[i] = np.log10(dist[longest(d, ctx, dist)])
            for b in used:
                grown = ((ctx << 8) | b) & ((1 << 8 * depth) - 1)
                table[i, classes[b]] = index[longest(min(d + 1, depth), grown, index)] * width
            table[i, width - 1], logp[i, width - 1] = i * width, 0.0
        begin = sum(END << 8 * k for k in range(depth))
        return cls(classes, width, index[longest(depth, begin, index)] * width, table.ravel(), logp.ravel(), len(dist))

    def score(self, stream: np.ndarray, edges: np.ndarray, lead: int = DEPTH) -> np.ndarray:
        """log10 probability of each text; each block first reads the ``lead`` bytes before it, which fix its state."""
        grid, text = blocks(self.classes[stream], edges, BLOCK, lead, self.width - 1)
        first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
        # A text's first block begins after END; the others' states follow from the bytes that lead.
        state = np.where(first, self.start, 0).astype(np.int32)
        total = np.zeros(len(text))
        for k, row in enumerate(grid):
            at = state + row
            state = self.table[at]
            if k >= lead:
                total += self.logp[at]
        return np.bincount(text, total, len(edges) - 1)


def count_training(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): kind 0 has words by hash, kind 1 runs of ``depth`` + 1 bytes; over all rows of ``docs`` (text)."""
    got = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(_count(depth), "kind int, key bigint, n bigint")
    return got.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tree:
    """The suffix tree as tables: ``contexts`` (d, ctx, back), ``seen`` (d, ctx, byte, over), the empty context left out of ``contexts``.

    ``back`` is what falling back from a context to the empty one adds to a log10
    probability; ``over`` is the log10 probability of a byte that the context was seen
    with, less ``back``. ``unseen`` is that of a byte that training never saw.
    """

    contexts: DataFrame
    seen: DataFrame
    unseen: float
    depth: int

    def log_probabilities(self, keys: DataFrame) -> DataFrame:
        """(key, logp) of different runs ``keys`` (key), whether training saw them or not."""
        levels = lambda least: F.explode(F.sequence(F.lit(least), F.lit(self.depth))).alias("d")
        mask = F.expr("shiftleft(1L, 8 * d) - 1")
        byte = F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("byte")
        above = keys.select(F.shiftright("key", 8).alias("above")).distinct().select("above", levels(1))
        backs = above.withColumn("ctx", F.col("above").bitwiseAND(mask)).join(self.contexts, ["d", "ctx"]).groupBy("above").agg(F.max_by("back", "d").alias("back"))
        placed = keys.select("key", F.shiftright("key", 8).alias("above"), byte, levels(0)).withColumn("ctx", F.col("above").bitwiseAND(mask))
        overs = placed.join(self.seen, ["d", "ctx", "byte"]).groupBy("key").agg(F.max_by("over", "d").alias("over"))
        out = keys.select("key", F.shiftright("key", 8).alias("above")).join(overs, "key", "left").join(backs, "above", "left")
        return out.select("key", (F.coalesce("over", F.lit(self.unseen)) + F.coalesce("back", F.lit(0.0))).alias("logp"))


def grow_tree(runs: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, smoothing: float = SMOOTHING) -> Tree:
    """The suffix tree of all ``runs`` (key, n), its tests made by joins.

    A context is kept if its test or that of a longer kept context below it passes, so
    the kept set is closed under taking suffixes.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")
    byte = F.col("key").bitwiseAND(F.lit(255)).cast("int")
    above = F.shiftright(F.col("key"), 8)
    mask = F.expr("shiftleft(1L, 8 * d) - 1")
    counts = runs.select(levels, above.alias("above"), byte.alias("byte"), "n").groupBy("d", F.col("above").bitwiseAND(mask).alias("ctx"), "byte").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("d", "ctx")))  # at most 256 rows a context
    counts = stored(counts, "suffix-counts")
    shorter = counts.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "byte", F.col("n").alias("un"), F.col("total").alias("ut"))
    up = F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 8 * (d - 1)) - 1"))
    gain = F.sum(F.col("n") * (F.log(F.col("n") / F.col("total")) - F.log(F.col("un") / F.col("ut"))))
    tests = counts.where("d > 0").withColumn("up", up).join(shorter, ["d", "up", "byte"]).groupBy("d", "ctx").agg(gain.alias("gain"), F.count(F.lit(1)).alias("kinds"))
    # Each further symbol of a distribution is a parameter that fits noise: half a unit by chance.
    passed = tests.where(F.col("gain") - F.col("kinds") > divergence).select("d", "ctx")
    ends = passed.select(F.explode(F.sequence(F.lit(1), F.col("d"))).alias("d"), "ctx")
    kept = ends.select("d", F.col("ctx").bitwiseAND(mask).alias("ctx")).distinct()
    rows = stored(counts.where("d > 0").join(kept, ["d", "ctx"], "left_semi"), "suffix-kept")
    total = counts.where("d = 0").agg(F.max("total")).first()[0] or 0
    # Root: add-half over all 256 bytes. Each level is smoothed towards the one before.
    level = counts.where("d = 0").select("d", "ctx", "byte", ((F.col("n") + 0.5) / (total + 128.0)).alias("p"), F.lit(0.0).alias("back"))
    seen = level
    for d in range(1, depth + 1):
        shorter = level.select(F.col("ctx").alias("up"), "byte", F.col("p").alias("up_p"), F.col("back").alias("up_back"))
        own = rows.where(F.col("d") == d).withColumn("up", up).join(shorter, ["up", "byte"])
        weight = F.col("total") + smoothing
        level = stored(own.select("d", "ctx", "byte", ((F.col("n") + smoothing * F.col("up_p")) / weight).alias("p"), (F.col("up_back") + F.log10(smoothing / weight)).alias("back")), "suffix-level")
        seen = seen.union(level)
    contexts = stored(seen.where("d > 0").groupBy("d", "ctx").agg(F.first("back").alias("back")), "suffix-contexts")
    seen = stored(seen.select("d", "ctx", "byte", (F.log10("p") - F.col("back")).alias("over")), "suffix-seen")
    return Tree(contexts, seen, math.log10(0.5 / (total + 128.0)), depth)


@dataclass(frozen=True)
class Held:
    """Log probabilities of runs by open addressing; a free place holds -1."""

    keys: np.ndarray
    logp: np.ndarray
    bits: int

    @staticmethod
    def _place(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, logp: np.ndarray) -> Held:
        bits = max(4, (3 * len(keys) // 2).bit_length())
        table, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        at = cls._place(keys, bits)
        for _ in range(PROBES):
            free = table[at] < 0
            table[at[free]] = keys[free]
            inside = table[at] == keys
            value[at[inside]] = logp[inside]
            keys, logp, at = keys[~inside], logp[~inside], (at[~inside] + 1) & ((1 << bits) - 1)
        return cls(table, value, bits)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability or 0, whether held) of each of ``keys``."""
        at = self._place(keys, self.bits)
        got = self.keys[at]
        known = got == keys
        value = np.where(known, self.logp[at], 0.0)
        left = np.flatnonzero(~known & (got >= 0))
        for k in range(1, PROBES):
            if not len(left):
                break
            place = (at[left] + k) & ((1 << self.bits) - 1)
            got = self.keys[place]
            same = got == keys[left]
            known[left[same]], value[left[same]] = True, self.logp[place[same]]
            left = left[~same & (got >= 0)]
        return value, known


@dataclass(frozen=True)
class Frequent:
    """Counts of the most frequent words by hash, sorted."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int


def least_count(by_count: DataFrame, limit: int) -> int | None:
    """The least count that at most ``limit`` of ``by_count`` (n, words) reach; None if none does."""
    ahead = F.sum("words").over(Window.orderBy(F.desc("n")))
    # One row per different count: far fewer than words, as k different counts need k * k / 2 words.
    return by_count.withColumn("ahead", ahead).where(F.col("ahead") <= limit).agg(F.min("n")).first()[0]


def frequent_runs(runs: DataFrame, tree: Tree, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log10 probabilities of the runs whose count is above the least bound that at most ``limit`` runs pass."""
    bound = least_count(runs.groupBy("n").agg(F.count(F.lit(1)).alias("words")), limit)
    if bound is None:
        return np.zeros(0, np.int64), np.zeros(0)
    got = tree.log_probabilities(runs.where(F.col("n") >= bound).select("key")).toArrow()
    return got.column("key").to_numpy(), got.column("logp").to_numpy()


def frequent_words(words: DataFrame, limit: int = FREQUENT) -> Frequent:
    """The words whose count is above the least bound that at most ``limit`` words pass, with all words' totals."""
    by_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    total = by_count.agg(F.sum(F.col("n") * F.col("words")).alias("total"), F.sum("words").alias("distinct")).first()
    bound = least_count(by_count, limit)
    if bound is None:
        return Frequent(np.zeros(0, np.int64), np.zeros(0, np.int64), int(total["total"] or 0), int(total["distinct"] or 0))
    got = words.where(F.col("n") >= bound).select("key", "n").toArrow()
    keys, counts = got.column("key").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(keys)
    return Frequent(keys[order], counts[order], int(total["total"]), int(total["distinct"]))


def _lists(first: np.ndarray, keys: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first), pa.array(keys)).cast(pa.list_(pa.int64()))


def _score(model, depth: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, frequent = model.value
        held = Held.build(*runs)
        scale = math.log10(frequent.total + 0.5 * (frequent.distinct + 1))
        log = np.log10(frequent.counts + 0.5) - scale
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            row, doc_id = batch.column("row"), batch.column("doc_id")
            for i, j in slices(offsets, SLICE):
                w = Words(data, offsets, i, j)
                stream, edges = byte_streams(w)
                run = _runs(stream, edges, depth)
                logp, held_run = held.look(run)
                score = np.bincount(np.repeat(np.arange(j - i), np.diff(edges)), logp, j - i).astype(np.float64)
                rare_runs = _lists(np.concatenate([[0], np.cumsum(~held_run)])[edges], run[~held_run])
                keys, back = np.unique(w.hashes().view(np.int64), return_inverse=True)
                at = np.searchsorted(frequent.keys, keys)
                known = np.zeros(len(keys), bool)
                inside = at < len(frequent.keys)
                known[inside] = frequent.keys[at[inside]] == keys[inside]
                value = np.zeros(len(keys))
                value[known] = log[at[known]]
                text = np.repeat(np.arange(j - i), np.diff(w.first))
                base = np.bincount(text, value[back], j - i).astype(np.float64)  # without words numpy counts in integers
                n_known = np.bincount(text, known[back], j - i).astype(np.int64)
                rare = ~known[back]
                # Words and runs for the join: each text's rare ones, text by text, with repeats.
                tail = _lists(np.concatenate([[0], np.cumsum(rare)])[w.first], keys[back[rare]])
                yield pa.RecordBatch.from_arrays(
                    [row.slice(i, j - i), doc_id.slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n_known), pa.array(base), pa.array(score), tail, rare_runs],
                    ["row", "doc_id", "n_words", "n_known", "base", "score", "rare", "rare_runs"],
                )

    return task


def score_texts(docs: DataFrame, training: DataFrame, depth: int = DEPTH, limit: int = FREQUENT) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) with what all rows of ``training`` (text) teach.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score. Tokens are the words,
    A-Z lower-cased, and an end; base_score is the sum of their smoothed unigram log10
    probabilities, score the suffix tree's log10 probability of the words' bytes with one
    blank between words and an end.

    A null or blank text is the end alone. Without training rows every word is unknown and
    all bytes are equally likely. Repeated rows, and rows that share a doc_id, are scored each
    by its own text. Very long texts are scored in full; an empty table gives an empty
    result. Other columns are not read.
    """
    counted = stored(count_training(training, depth), "lm-counts")
    ends = training.count()
    words = counted.where("kind = 0").select("key", "n")
    runs = counted.where("kind = 1").select("key", "n")
    tree = grow_tree(runs, depth)
    frequent = frequent_words(words, limit)
    n, v = frequent.total + ends, frequent.distinct + (ends > 0)
    model = docs.sparkSession.sparkContext.broadcast((frequent_runs(runs, tree, limit), Frequent(frequent.keys, frequent.counts, n, v)))
    # A row's number keeps rows that share a doc_id apart; it is fixed once the table is stored.
    texts_in = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    shape = "row bigint, doc_id bigint, n_words bigint, n_known bigint, base double, score double, rare array<bigint>, rare_runs array<bigint>"
    scored = stored(texts_in.mapInArrow(_score(model, depth), shape), "lm-scored")
    scale = math.log10(n + 0.5 * (v + 1))
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("k"))
    looked = rare.join(words, "key", "left").groupBy("row").agg(
        F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - scale)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("also_known")
    )
    rare_runs = scored.select("row", F.explode("rare_runs").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("k"))
    logp = tree.log_probabilities(stored(scored.select(F.explode("rare_runs").alias("key")).distinct(), "lm-rare-runs"))
    steps = rare_runs.join(logp, "key").groupBy("row").agg(F.sum(F.col("k") * F.col("logp")).alias("steps"))
    end = math.log10(ends + 0.5) - scale
    return scored.drop("rare", "rare_runs").join(looked, "row", "left").join(steps, "row", "left").select(
        "doc_id",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("also_known", F.lit(0)) + (1 if ends else 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + end).alias("base_score"),
        (F.col("score") + F.coalesce("steps", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All documents scored by what four fifths of them teach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 1
    scored = score_texts(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
