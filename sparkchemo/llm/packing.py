"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become ids in Arrow tasks; only lengths and checksums go on. Pieces as long as a
sequence are sequences already. The others are dealt into groups of bounded size, and each
group is packed on its own: best fit by falling length, then a local search over underfull
bins that moves and exchanges pieces as long as the sum of squared fills rises, which
empties bins. A group is at most about one sequence short of its ideal.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import stored
from sparkchemo.llm.textkit import Words, slices, texts

END_ID, MAX_TOKENS = 1, 4096
#: Pieces packed together in one task.
GROUP = 8192
#: Words whose ids a worker remembers (about 20 bytes each), bytes of text worked on at a time, words encoded at a time.
MEMORY, SLICE, AT_ONCE = 2_000_000, 4 << 20, 1000
#: Between words that are encoded together; it is one id, and a word that has it is encoded alone.
MARK = b"\x01"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True

_encoders: dict[str, WordEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and case: words are encoded apart and remembered.

    A word is also cut where a sign follows a letter, which this kind of tokenizer does
    anyway, so that a word is remembered once for all signs that follow it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids[0]
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """A worker's encoder of this file."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def forget(self) -> None:
        self.keys, self.place, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remember ``words`` under ``keys`` (ascending, all new)."""
        parts, sizes = [], []
        for k in range(0, len(words), AT_ONCE):
            own = words[k : k + AT_ONCE]
            if any(MARK in x for x in own):
                got = [np.array(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids, np.uint32) for x in own]
                parts += got
                sizes += map(len, got)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([(b" " + MARK + b" ").join(own).decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark)
            sizes += (np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1).tolist()
            parts.append(np.delete(ids, cuts))
        size = np.array(sizes, np.int64)
        at = np.searchsorted(self.keys, keys)
        place = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *parts])
        self.keys, self.place, self.size = np.insert(self.keys, at, keys), np.insert(self.place, at, place), np.insert(self.size, at, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of texts i..j-1 in order, places where each text begins and the end)."""
        w = Words(data, offsets, i, j)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
        buffer = w.data.tobytes()
        if any(x in buffer for x in self.special):  # a special token counts only as it is written
            w = Words(data, offsets, i, j, lower=False)
            buffer = w.data.tobytes()
        else:
            w.split(np.flatnonzero(_LETTER[w.data[:-1]] & _SIGN[w.data[1:]]) + 1)
        keys, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMORY:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            start, end = w.start[first[new]].tolist(), w.end[first[new]].tolist()
            self._learn(keys[new], [buffer[a:b] for a, b in zip(start, end, strict=True)])
            at = np.searchsorted(self.keys, keys)
        count = self.size[at][back]
        ends = np.cumsum(count)
        places = np.repeat(self.place[at][back] - (ends - count), count) + np.arange(int(ends[-1]))
        return self.ids[places], np.concatenate([[0], ends])[w.first]


def _cut(path: str, end_id: int, limit: int, with_ids: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = WordEncoder.of(path), np.array([end_id], np.uint32)
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            doc_id = batch.column("doc_id").to_pylist()
            for i, j in slices(offsets, SLICE):
                ids, first = encoder.encode(data, offsets, i, j)
                rows = []
                for k in range(j - i):
                    own = np.append(ids[first[k] : first[k + 1]], tail)
                    for n, a in enumerate(range(0, len(own), limit)):
                        piece = own[a : a + limit]
                        rows.append((doc_id[i + k], n, a, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), *([piece] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[: len(rows[0])])

    return task


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, limit: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Every document's ids plus ``end_id``, cut after each ``limit`` ids: doc_id, piece, start, length, ids_crc32[, ids]."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(_cut(vocabulary or default_vocabulary(), end_id, limit, with_ids), schema)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of indexes: by falling length, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = bisect_left(room, (lengths[k], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = limit, len(bins)
            bins.append([])
        bins[b].append(k)
        if free > lengths[k]:
            insort(room, (free - lengths[k], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Local search: the emptiest bin gives pieces to other underfull bins until it is empty.

    A step moves a piece, exchanges one for a smaller one, or two for a smaller one: of all
    such steps the one that raises the sum of squared fills most. The search ends when every
    underfull bin has been the giver in vain since one was last emptied, or when no fewer
    bins could hold the pieces.
    """
    n = np.array(lengths, np.int64)
    place = np.zeros(len(n), np.int64)
    for b, own in enumerate(bins):
        place[own] = b
    fill = np.bincount(place, n, len(bins)).astype(np.int64)
    tried, least = np.zeros(len(bins), bool), -(-int(n.sum()) // limit)
    while (fill > 0).sum() > least:
        giver = np.where((fill > 0) & (fill < limit) & ~tried, fill, limit)
        b = int(giver.argmin())
        if giver[b] == limit:
            break
        while fill[b] and (step := _best_step(b, place, n, fill, limit)):
            give, take, other = step
            gain = int(n[give].sum() - n[take].sum())
            place[give], place[take] = other, b
            fill[b], fill[other] = fill[b] - gain, fill[other] + gain
        if fill[b]:
            tried[b] = True
        else:
            tried[:] = False
    return [own.tolist() for b in np.flatnonzero(fill) for own in [np.flatnonzero(place == b)]]


def _best_step(giver: int, place: np.ndarray, n: np.ndarray, fill: np.ndarray, limit: int) -> tuple[list[int], list[int], int] | None:
    """(pieces given, pieces taken, the other bin) of the step that raises the squares most; None if there is none.

    Pieces of equal length are alike, and a bin of ``limit`` has at most about sqrt(2 * limit)
    different lengths, so all steps are looked at.
    """
    own: dict[int, list[int]] = {}
    for k in np.flatnonzero(place == giver).tolist():
        own.setdefault(int(n[k]), []).append(k)
    sizes = sorted(own)
    offers = {m: own[m][:1] for m in sizes}
    for i, m in enumerate(sizes):
        for o in sizes[i if len(own[m]) > 1 else i + 1 :]:
            offers.setdefault(m + o, [own[m][0], own[o][1 if m == o else 0]])
    sums = np.array(sorted(offers))
    # A row for each underfull bin (a move) and for each piece of one (an exchange).
    under = (fill > 0) & (fill < limit)
    under[giver] = False
    bins, pieces = np.flatnonzero(under), np.flatnonzero(under[place])
    to, back = np.concatenate([bins, place[pieces]]), np.concatenate([np.zeros(len(bins), np.int64), n[pieces]])
    at = np.searchsorted(sums, back + limit - fill[to], "right") - 1
    gain = np.where(at >= 0, sums[np.maximum(at, 0)] - back, 0)
    rise = np.where(gain > 0, gain * (fill[to] - fill[giver] + gain), 0)
    k = int(rise.argmax()) if len(rise) else 0
    if not len(rise) or rise[k] <= 0:
        return None
    return offers[int(sums[at[k]])], [int(pieces[k - len(bins)])] if k >= len(bins) else [], int(to[k])


def _pack(limit: int) -> Callable:
    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        group = table.column("pack")[0].as_py()
        seq, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, own in enumerate(improve(best_fit(lengths, limit), lengths, limit)):
            at = 0
            for k in own:
                seq[k], place[k] = (group << 32) + b, at
                at += lengths[k]
        return table.drop_columns(["pack"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(place))

    return task


def pack(cut: DataFrame, limit: int = MAX_TOKENS, group: int = GROUP) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Groups are dealt by a hash of document and piece, so equal documents spread too, and
    there are as many as the pieces need: a task packs about ``group`` pieces at any scale.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = cut.select(names)
    rest = cut.where(F.col("length") < limit)
    groups = max(1, -(-rest.count() // group))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    packed = rest.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).groupBy("pack").applyInArrow(_pack(limit), out)
    whole = cut.where(F.col("length") >= limit).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, limit: int = MAX_TOKENS) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into sequences of at most ``limit`` ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Only documents longer than ``limit`` ids are cut. ``vocabulary`` is the file of a
    tokenizer whose words never reach across white space; every node must have it.

    A null or empty text is the end id alone. Repeated rows are packed each. A very long text
    is cut into as many pieces as it needs. An empty table gives an empty result. Other
    columns are not read.
    """
    return pack(stored(pieces(docs, vocabulary, end_id, limit), "pieces"), limit)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
