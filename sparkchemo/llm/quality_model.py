"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover it whole. In each chunk learned
filters slide over embedded bytes, each filter's largest response is kept, and a small
layer turns these into a chunk's logit. The mean and the least of a document's chunk
logits combine into one probability. The network is trained on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import fold
from sparkchemo.llm.textkit import slices, texts

#: Bytes of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 1024, 64
#: Size of a byte's embedding; width, step and number of filters; hidden units.
EMBED, WIDTH, STEP, FILTERS, HIDDEN = 4, 12, 4, 40, 16
#: The sample: rows and bytes of whole texts for each label, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 5_000_000
EPOCHS, BATCH, RATE, SEED = 14, 24, 0.004, 7
#: Share of training texts whose letters are exchanged at random, so that spelling alone can't decide.
CIPHERED = 0.5
SLICE = 1 << 19
THRESHOLD = 0.3


def chunk_places(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each chunk begins, its text); an empty text has one chunk."""
    length = np.diff(offsets)
    hop = CHUNK - OVERLAP
    count = np.maximum(1, -(-(length - OVERLAP) // hop))
    text = np.repeat(np.arange(len(length)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][text] + nth * hop, text


def cut_chunks(data: np.ndarray, offsets: np.ndarray, begin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The chunks [n, CHUNK] that begin there, padded with 0 beyond their text."""
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][text][:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = data[at[inside]]
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all chunks, each one's text)."""
    begin, text = chunk_places(offsets)
    return cut_chunks(data, offsets, begin, text), text


def cipher(rng: np.random.Generator) -> bytes:
    """A random exchange of the letters, the same for small and capital ones."""
    table, order = np.arange(256, dtype=np.uint8), rng.permutation(26)
    table[97:123], table[65:91] = 97 + order, 65 + order
    return table.tobytes()


class ByteNet:
    """The network's parameters, its forward pass, and its gradient."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(size=shape).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBED) * 0.5,
            "filters": normal(WIDTH * EMBED, FILTERS) / np.sqrt(WIDTH * EMBED * 0.25),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(FILTERS, HIDDEN) / np.sqrt(FILTERS),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN) / np.sqrt(HIDDEN),
            "out_bias": np.zeros(1, np.float32),
            "pool": np.array([1.0, 0.5, 0.0], np.float32),  # of the mean, of the least, constant
        }
        self.prior = 0.0

    def respond(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each filter's largest response [n, FILTERS], windows [n, places, WIDTH * EMBED])."""
        e = np.ascontiguousarray(self.p["embed"][grid]).reshape(len(grid), -1)
        places = (CHUNK - WIDTH) // STEP + 1
        windows = as_strided(e, (len(grid), places, WIDTH * EMBED), (e.strides[0], STEP * EMBED * e.itemsize, e.itemsize))
        return np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.p["filters"], windows

    def forward(self, grid: np.ndarray, text: np.ndarray, n: int, keep: bool = False):
        """Logits of ``n`` texts; with ``keep`` also what the gradient needs."""
        p = self.p
        raw, windows = self.respond(grid)
        raw = raw.reshape(len(grid), -1, FILTERS)
        top = raw.max(1) + p["bias"]
        pooled = np.maximum(top, 0)
        inner = pooled @ p["hidden"] + p["hidden_bias"]
        hidden = np.maximum(inner, 0)
        logit = hidden @ p["out"] + p["out_bias"][0]
        size = np.bincount(text, minlength=n)
        first = np.cumsum(size) - size
        mean, least = np.bincount(text, logit, n) / size, np.minimum.reduceat(logit, first)
        out = p["pool"][0] * mean + p["pool"][1] * least + p["pool"][2]
        return (out, (raw, windows, top, pooled, inner, hidden, logit, size, mean, least)) if keep else out

    def gradient(self, grid: np.ndarray, text: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Gradient of the mean log loss, and the loss."""
        p, n = self.p, len(label)
        out, (raw, windows, top, pooled, inner, hidden, logit, size, mean, least) = self.forward(grid, text, n, True)
        prob = 1 / (1 + np.exp(-out))
        loss = -np.mean(np.log(np.where(label == 1, prob, 1 - prob) + 1e-9))
        d = ((prob - label) / n).astype(np.float32)
        g = {"pool": np.array([d @ mean, d @ least, d.sum()], np.float32)}
        dl = d[text] * (p["pool"][0] / size[text] + p["pool"][1] * (logit == least.astype(logit.dtype)[text]))
        dl = dl.astype(np.float32)
        g["out"], g["out_bias"] = dl @ hidden, dl.sum(keepdims=True)
        di = np.outer(dl, p["out"]) * (inner > 0)
        g["hidden"], g["hidden_bias"] = pooled.T @ di, di.sum(0)
        dt = (di @ p["hidden"].T) * (top > 0)
        g["bias"] = dt.sum(0)
        best = raw.argmax(1)  # [chunks, FILTERS]
        picked = windows[np.arange(len(grid))[:, None], best]  # [chunks, FILTERS, WIDTH * EMBED]
        g["filters"] = np.einsum("cf,cfk->kf", dt, picked, optimize=True)
        # Back into the embeddings of the bytes under each largest response.
        de = (dt[:, :, None] * p["filters"].T[None]).reshape(-1, EMBED)
        under = grid[np.arange(len(grid))[:, None, None], best[:, :, None] * STEP + np.arange(WIDTH)].ravel()
        g["embed"] = np.stack([np.bincount(under, de[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return g, float(loss)

    def train(self, data: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
        """Adam over whole documents in seeded order, both labels weighing the same."""
        rng = np.random.default_rng(seed)
        mean, square, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        groups = [np.flatnonzero(labels == k) for k in (0, 1)]
        size = max(map(len, groups))
        steps = max(1, -(-2 * size // BATCH)) * epochs
        for _ in range(epochs):
            # The rarer label's documents come again until both are as many.
            order = np.concatenate([rng.permutation(np.resize(rng.permutation(g), size)) for g in groups])
            order = rng.permutation(order)
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                buffer = np.frombuffer(b"".join(data[k].translate(cipher(rng)) if rng.random() < CIPHERED else data[k] for k in own), np.uint8)
                grid, text = chunks(buffer, np.concatenate([[0], np.cumsum([len(data[k]) for k in own])]))
                g, _ = self.gradient(grid, text, labels[own])
                t += 1
                rate = RATE * (1 - 0.95 * t / (steps + 1))
                for k, v in g.items():
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.01 * (v * v - square[k])
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        begin, text = chunk_places(offsets)
        n = len(offsets) - 1
        p, logit = self.p, []
        for a in range(0, len(text), 256):
            raw, _ = self.respond(cut_chunks(data, offsets, begin[a : a + 256], text[a : a + 256]))
            top = raw.reshape(-1, (CHUNK - WIDTH) // STEP + 1, FILTERS).max(1) + p["bias"]
            logit.append(np.maximum(np.maximum(top, 0) @ p["hidden"] + p["hidden_bias"], 0) @ p["out"] + p["out_bias"][0])
        logit = np.concatenate(logit)
        size = np.bincount(text, minlength=n)
        out = p["pool"][0] * np.bincount(text, logit, n) / size + p["pool"][1] * np.minimum.reduceat(logit, np.cumsum(size) - size) + p["pool"][2]
        return 1 / (1 + np.exp(-(out + self.prior)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> ByteNet:
    """Train on a bounded sample of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    For each label the first ``rows`` ids by hash; of these a text is left out if it does
    not fit in ``max_bytes`` with those before it. The share of label 1 among all labelled rows sets the
    probability's base rate. Rows without a label or text are not learned from; if a
    label has none, the base rate alone is the score.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = docs.where(F.col("text").isNotNull()).select("doc_id", F.octet_length("text").alias("bytes")).join(marked, "doc_id")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    # About three times the rows that are wanted pass, always those that come first by hash, however many a label has.
    most = F.when(F.col("quality") == 1, 3 * rows / max(1, share.get(1, 0))).otherwise(3 * rows / max(1, share.get(0, 0)))
    place = (F.xxhash64("doc_id") / float(1 << 64)) + 0.5
    few = known.where(place < most).withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows)
    chosen, used = [], {}
    for r in sorted(few.collect(), key=lambda r: r["k"]):  # 2 * rows small rows at most
        if used.get(r["quality"], 0) + r["bytes"] <= max_bytes:
            used[r["quality"]] = used.get(r["quality"], 0) + r["bytes"]
            chosen.append((r["doc_id"], r["quality"]))
    chosen = docs.sparkSession.createDataFrame(chosen, known.select("doc_id", "quality").schema)
    got = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").collect()  # 2 * max_bytes at most
    got = sorted(((r["doc_id"], r["quality"], bytes(r["text"])) for r in got), key=lambda r: r[:2])
    net = ByteNet()
    y = np.array([q for _, q, _ in got], np.float32)
    if len(set(y.tolist())) == 2:
        net.train([t for _, _, t in got], y, epochs)
    else:
        net.p["pool"] = np.zeros_like(net.p["pool"])  # nothing but the base rate reaches the score
    net.prior = float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))
    return net


def _score(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteNet = model.value
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            got = [net.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SLICE)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return task


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id and score (probability of label 1) of every row of ``docs`` (doc_id, text).

    Null and empty texts are scored as one empty chunk. Every byte of a long text lies in
    a chunk. Repeated rows are scored each; an empty table gives an empty result. Other
    columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_score(model), "doc_id bigint, score double")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from four fifths of the labels; null and empty texts have a score too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 0
    net = fit(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    return score_quality(docs, net).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
