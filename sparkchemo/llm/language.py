"""Language ID by cross-parsing: the language whose text needs the fewest phrases wins.

Per language a suffix automaton of labelled text accepts exactly the substrings of that
text. A document is parsed greedily into phrases, each the longest match from where the
last one ended; c phrases over m symbols against n symbols of training text estimate the
cross entropy c log2(n) / m. The automata are fitted on a bounded sample and then read
every document in full, as tables that step through many blocks of text at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import fold, stored
from sparkchemo.llm.lockstep import blocks
from sparkchemo.llm.textkit import slices, texts

#: The sample of each language: whole texts of at most so many documents, and so many bytes together.
SAMPLE_DOCS, TRAIN_BYTES = 200, 24_000
#: Characters of a piece of a text that is longer than the sample.
PIECE = 2000
#: Languages whose automata a task holds at once; more are parsed in several passes.
PART = 64
BLOCK, SLICE = 512, 2 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def symbols() -> np.ndarray:
    """Byte -> symbol: A-Z are a-z, and every other ASCII byte is the gap between words."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        out[b] = ord(chr(b).lower()) if chr(b).isalpha() else GAP
    return out


GAP = ord(" ")
SYMBOLS = symbols()


def spelled(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts with each run of gaps as one, and their new edges: marks between letters say little."""
    out = SYMBOLS[data]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
    sizes = [np.count_nonzero(keep[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return out[keep], int(np.count_nonzero(keep[: edges[0]])) + np.cumsum([0, *sizes])


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the substrings of ``text``."""
    go: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
        last = new
    return go


@dataclass(frozen=True)
class CrossParser:
    """Automata of all languages in one table.

    ``classes`` has a symbol's class. ``table[state * width + class]`` is the next state times ``width``; bitwise negated if
    a phrase ends before this symbol, which then begins the next phrase. The last class
    is padding and changes nothing.
    """

    languages: tuple[str, ...]
    sizes: tuple[int, ...]
    classes: np.ndarray
    width: int
    starts: np.ndarray
    table: np.ndarray

    @classmethod
    def fit(cls, samples: dict[str, bytes]) -> CrossParser:
        data = {k: spelled(np.frombuffer(v, np.uint8), np.zeros(1, np.int64))[0] for k, v in sorted(samples.items())}
        used = np.unique(np.concatenate(list(data.values())))
        width = len(used) + 2  # an unseen symbol's class, padding
        classes = np.full(256, len(used), np.uint8)
        classes[used] = np.arange(len(used))
        parts, starts, at = [], [], 0
        for own in data.values():
            go = suffix_automaton(np.searchsorted(used, own).tolist())
            part = np.full((len(go), width), -1, np.int64)
            rows = np.repeat(np.arange(len(go)), [len(x) for x in go])
            part[rows, np.fromiter((c for x in go for c in x), np.int64)] = np.fromiter((s for x in go for s in x.values()), np.int64)
            root = np.where(part[0] < 0, 0, part[0])
            full = np.where(part < 0, ~((root[None, :] + at) * width), (part + at) * width)
            full[0] = ~((root + at) * width)  # whatever follows the root begins a phrase
            full[:, -1] = (np.arange(len(go)) + at) * width
            parts.append(full)
            starts.append(at * width)
            at += len(go)
        return cls(tuple(data), tuple(map(len, data.values())), classes, width, np.array(starts, np.int32), np.concatenate(parts).astype(np.int32).ravel())

    def phrases(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> np.ndarray:
        """[languages, texts]: phrases of texts i..j-1. A phrase ends at the latest after each BLOCK symbols, for all languages alike."""
        own, edges = spelled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        grid, text = blocks(self.classes[own], edges, BLOCK, 0, self.width - 1)
        out = np.zeros((len(self.languages), j - i), np.int64)
        if not len(text):
            return out
        for k, start in enumerate(self.starts):
            state, count = np.full(len(text), start, np.int32), np.zeros(len(text), np.int32)
            for row in grid:
                got = self.table[state + row]
                over = got >> 31
                count -= over
                state = got ^ over
            out[k] = np.bincount(text, count, j - i).astype(np.int64)
        return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, train_bytes: int = TRAIN_BYTES) -> dict[str, bytes]:
    """Each language's texts to learn from, a bounded sample of the rows of ``docs`` (doc_id, text, lang).

    The ``sample_docs`` first texts of a language by a hash of their ids are looked at in that order, and each that
    still fits into ``train_bytes`` is taken whole. Texts that are longer than ``train_bytes`` are looked at in pieces
    of PIECE characters (an eighth of ``train_bytes`` at most), each with a place of its own in that order. Empty if no row has both text and lang. Equal
    rows are one; other rows that share a doc_id are each a text.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    long, size = F.octet_length("text") >= train_bytes, max(1, min(PIECE, train_bytes // 8))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda k: F.struct(F.xxhash64("doc_id", k).alias("place"), F.substring("text", k * size + 1, F.lit(size)).alias("text")))
    whole = F.array(F.struct(F.xxhash64("doc_id").alias("place"), F.col("text")))
    parts = known.select("doc_id", "lang", F.explode(F.when(long, cut).otherwise(whole)).alias("p")).select("doc_id", "lang", "p.place", "p.text")
    parts = parts.withColumns({"bytes": F.octet_length("text"), "mark": F.xxhash64("text")})
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("place", "doc_id", "bytes", "mark"))
    # First in each of 64 parts of a language, so that the last choice sees few rows, whatever the corpus.
    drawn = parts.drop("text").distinct().withColumn("part", F.pmod("place", F.lit(64))).withColumn("k", first("lang", "part")).where(F.col("k") <= sample_docs)
    drawn = drawn.withColumn("k", first("lang")).where(F.col("k") <= sample_docs)
    used: dict[str, int] = {}
    chosen = set()
    for r in sorted(drawn.collect(), key=lambda r: r["k"]):  # sample_docs small rows a language at most
        if used.get(r["lang"], 0) + r["bytes"] < train_bytes:
            used[r["lang"]] = used.get(r["lang"], 0) + r["bytes"] + 1
            chosen.add((r["doc_id"], r["lang"], r["place"], r["bytes"], r["mark"]))
    if not chosen:
        return {}
    keys = ["lang", "place", "bytes", "mark"]
    wanted = docs.sparkSession.createDataFrame(sorted({c[1:] for c in chosen}), parts.select(*keys).schema)
    rows = parts.join(F.broadcast(wanted), keys, "left_semi").select("doc_id", "lang", F.col("text").cast("binary").alias("text")).distinct()
    samples: dict[str, bytearray] = {}
    for row in sorted(rows.collect(), key=lambda r: (r["doc_id"] is not None, r)):  # train_bytes a language
        own = samples.setdefault(row["lang"], bytearray())
        if len(own) + len(row["text"]) < train_bytes:
            own += row["text"] + b"\n"
    return {k: bytes(v) for k, v in samples.items() if v}


def _predict(model, last: bool):
    """One pass: the two least costs so far and the language of the least; the ``last`` pass gives the answer instead."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser: CrossParser | None = model.value
        names = [UNKNOWN, *parser.languages] if parser else [UNKNOWN]
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            size = batch.num_rows
            first, second, chosen = np.full(size, np.inf), np.full(size, np.inf), np.zeros(size, np.int64)
            letters = np.zeros(size, bool)
            for i, j in slices(offsets, SLICE) if parser else ():
                weight = np.array([math.log2(max(2, n)) for n in parser.sizes])[:, None]
                cost = parser.phrases(data, offsets, i, j) * weight
                order = np.argsort(cost, axis=0, kind="stable")
                first[i:j] = np.take_along_axis(cost, order[:1], 0)[0]
                if len(cost) > 1:
                    second[i:j] = np.take_along_axis(cost, order[1:2], 0)[0]
                chosen[i:j] = order[0] + 1
                for k in range(i, j) if last else ():
                    letters[k] = _has_letter(data[offsets[k] : offsets[k + 1]])
            found = pa.array(names).take(pa.array(chosen))
            if "first" in batch.schema.names:
                one, two = (batch.column(c).to_numpy() for c in ("first", "second"))
                # A tie stays with the earlier pass, whose languages come first by name.
                found = pc.if_else(pa.array(one <= first), batch.column("lang"), found)
                first, second = np.minimum(one, first), np.minimum(np.maximum(one, first), np.minimum(two, second))
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), found, pa.array(first), pa.array(second)], ["doc_id", "text", "lang", "first", "second"])
                continue
            second = np.where(np.isinf(second), first * 2, second)
            # 0.5 for a tie, towards 1 as the next language needs more phrases; without a letter or a language there is none.
            sure = np.zeros(size)
            sure[letters] = second[letters] / np.maximum(first[letters] + second[letters], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.if_else(pa.array(letters), found, pa.scalar(UNKNOWN)), pa.array(sure)], ["doc_id", "lang_pred", "lang_score"])

    return task


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(own: np.ndarray) -> bool:
    return bool(_ASCII_LETTER[own[:256]].any() or _ASCII_LETTER[own].any() or _LETTER.search(own.tobytes().decode("utf-8", "replace")))


def predict(docs: DataFrame, samples: dict[str, bytes], part: int = PART) -> DataFrame:
    """doc_id, lang_pred and lang_score of every row of ``docs`` (doc_id, text); nothing else is read.

    ``samples`` is what ``fit`` gives. ``lang_pred`` is ``und`` with score 0 for a null or
    empty text and one without a letter, and for all if ``samples`` is empty.
    The score is second / (best + second) phrase costs, 0.5 for a tie, which the first
    language by name wins. Whole texts are read, however long. Repeated rows are predicted
    each; an empty table gives an empty result. More than ``part`` languages are parsed in
    several passes, with the texts stored in between.
    """
    names = sorted(samples)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    for at in range(0, max(1, len(names)), part):
        own = names[at : at + part]
        last = at + part >= len(names)
        model = docs.sparkSession.sparkContext.broadcast(CrossParser.fit({k: samples[k] for k in own}) if own else None)  # at most 2 * TRAIN_BYTES states a language
        if last:
            return rows.mapInArrow(_predict(model, True), f"doc_id {id_type}, lang_pred string, lang_score double")
        rows = stored(rows.mapInArrow(_predict(model, False), f"doc_id {id_type}, text binary, lang string, first double, second double"), "language-pass")
        model.unpersist()


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    samples = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return predict(docs, samples).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
