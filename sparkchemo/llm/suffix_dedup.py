"""Removal of repeated passages by a depth-limited radix sort of all suffixes.

Every byte place of a text begins a suffix, and only its first ``width`` bytes, its
window, matter. Windows are dealt into groups by one digit after the other, most
significant first; a group of one drops out, and what is still together after the last
digit is equal. A digit is a function of the window's bytes, so equal windows always share it.

1. The first digit is the least hash of the window's grams of ``width // 2`` bytes. It is the
   same for runs of neighbouring windows (about 50 at 200 bytes), so Spark shuffles a row for
   each run, not for each byte, and in prose most runs are alone.
2. The second digit is all bytes that the windows of a run cover: runs that equal another
   run are repeated as a whole.
3. Windows of the other runs are sorted by eight bytes at a time, in a task as long as a
   group's runs are small enough for it; larger groups are dealt once more by a hash of the
   whole window, beside which the first digit still holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import let_through, release, stored
from sparkchemo.llm.textkit import BASE, BASE_INVERSE, BYTE_CODES, mix, powers, texts

#: Bytes of a window.
WIDTH = 200
#: Byte places that the first digit is worked out for at a time.
STRETCH = 1 << 18
#: Bytes of a group's different runs up to which one task sorts it, and bytes sorted together.
GROUP_BYTES, SORT_BYTES = 1 << 18, 4 << 20
_ONE = np.uint64(1)


def sliding(x: np.ndarray, w: int, pick=np.minimum) -> np.ndarray:
    """The least (or with np.maximum the largest) of each ``w`` neighbours, from two running ones per block of w."""
    n = len(x)
    filled = np.full(-(-n // w) * w, 0 if pick is np.maximum else np.iinfo(np.uint64).max, np.uint64)
    filled[:n] = x
    rows = filled.reshape(-1, w)
    ahead, back = pick.accumulate(rows, 1).ravel(), pick.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


class Runs:
    """The runs of windows of a stretch that share the first digit.

    ``start`` (byte place in the buffer), ``length`` (windows), ``digit`` and ``block`` (hash of the bytes covered) by run;
    ``grams``: byte places of the grams that are some window's least one, with ``values``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int, width: int):
        gram = width // 2
        w = width - gram + 1
        d = data[a : b + width - 1]
        n = len(d) - width + 1
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum(BYTE_CODES[d] * powers(BASE, len(d)), out=sums[1:])
        back = powers(BASE_INVERSE, len(d) + 1)
        h = np.maximum(mix((sums[gram:] - sums[: len(d) - gram + 1]) * back[: len(d) - gram + 1]), _ONE)
        m = sliding(h, w)
        # A window that would leave its text is none.
        ends = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b + width, "left")] - a
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.clip(ends - width + 1, 0, n), 1)
        np.add.at(step, np.clip(ends, 0, n), -1)
        m[np.cumsum(step)[:n] > 0] = 0
        edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        length, digit = np.diff(np.append(edge, n)), m[edge]
        real = digit > 0
        start, self.length, self.digit = edge[real], length[real], digit[real]
        self.block = mix((sums[start + self.length - 1 + width] - sums[start]) * back[start])
        self.start = start + a
        wide = np.concatenate([np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)])
        least = np.flatnonzero(sliding(wide, w, np.maximum) == h)
        self.grams, self.values = least + a, h[least]


def stretches(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[Runs]:
    """All runs of a batch of texts, a stretch of the buffer at a time, whatever the texts' lengths."""
    first, last = int(offsets[0]), int(offsets[-1]) - width + 1
    for a in range(first, last, STRETCH):
        yield Runs(data[: offsets[-1]], offsets, a, min(a + STRETCH, last), width)


def _first_digits(width: int):
    """(row, digit, n): each text's different digits and how many of its grams have them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            for runs in stretches(data, offsets, width):
                row = np.searchsorted(offsets, runs.grams, "right") - 1
                order = np.lexsort((runs.values, row))
                row, value = row[order], runs.values[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(row)))
                at = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(value[first].view(np.int64)), pa.array(n)], ["doc_id", "key", "digit", "n"])

    return task


def _cut_runs(width: int):
    """The runs whose digit is among those of the batch, with the bytes that they cover."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            alive = np.unique(batch.column("digits").flatten().to_numpy()).view(np.uint64)
            alive.sort()
            for runs in stretches(data, offsets, width):
                at = np.minimum(np.searchsorted(alive, runs.digit), max(len(alive) - 1, 0))
                own = np.flatnonzero(alive[at] == runs.digit) if len(alive) else np.zeros(0, np.int64)
                start, length = runs.start[own], runs.length[own]
                row = np.searchsorted(offsets, start, "right") - 1
                covered = [data[s : s + n + width - 1].tobytes() for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(start - offsets[row]), pa.array(length), pa.array(runs.digit[own].view(np.int64)), pa.array(runs.block[own].view(np.int64)), pa.array(covered, pa.binary())],
                    ["doc_id", "key", "start", "length", "digit", "block", "bytes"],
                )

    return task


def radix_sort(data: np.ndarray, start: np.ndarray, group: np.ndarray, open_: np.ndarray, width: int) -> np.ndarray:
    """The windows (as indices) that equal another one of their group.

    Most significant digits of eight bytes first; a group of one window, or without a window
    that is still ``open_``, goes no further.
    """
    big = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        big = (big << np.uint64(8)) | data[k : k + len(big)]
    live, rank = np.arange(len(start)), group
    for d in range(0, width, 8):
        if not len(live):
            break
        digit = big[start[live] + min(d, width - 8)]
        order = np.lexsort((digit, rank))
        live, rank, digit = live[order], rank[order], digit[order]
        own = np.cumsum(np.concatenate([[0], (rank[1:] != rank[:-1]) | (digit[1:] != digit[:-1])]))
        stays = (np.bincount(own) > 1) & (np.bincount(own, open_[live]) > 0)
        live, rank = live[stays[own]], own[stays[own]]
    return live


def _spans(at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of runs of neighbouring places; both arrays are sorted by row, then place."""
    if not len(at):
        return row, at, at
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first], at[last] + 1


def _finish(width: int):
    """(digit, block, from, to): repeated windows of runs that equal no other run; groups come whole and one after the other."""

    def sort(table: pa.Table) -> pa.RecordBatch:
        digit, block, n, length = (table.column(c).to_numpy() for c in ("digit", "block", "n", "length"))
        data, offsets = texts(table.column("bytes"))
        run = np.repeat(np.arange(len(digit)), length)
        place = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
        group = np.cumsum(np.concatenate([[0], digit[1:] != digit[:-1]]))
        found = radix_sort(data, offsets[run] + place, group[run], n[run] == 1, width)
        found = np.sort(found[n[run[found]] == 1])
        row, a, b = _spans(place[found], run[found])
        return pa.RecordBatch.from_arrays([pa.array(digit[row]), pa.array(block[row]), pa.array(a), pa.array(b)], ["digit", "block", "from", "to"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            digit = batch.column("digit").to_numpy()
            cuts = np.append(np.flatnonzero(digit[1:] != digit[:-1]) + 1, len(digit)) if len(digit) else []
            lengths = np.cumsum(np.diff(texts(batch.column("bytes"))[1]))
            done = 0
            for cut in cuts:
                if held and size > SORT_BYTES and held[-1].num_rows and digit[done] != held[-1].column("digit")[-1].as_py():
                    yield sort(pa.Table.from_batches(held).combine_chunks())
                    held, size = [], 0
                held.append(batch.slice(done, cut - done))
                size += int(lengths[cut - 1] - (lengths[done - 1] if done else 0))
                done = int(cut)
        if held:
            yield sort(pa.Table.from_batches(held).combine_chunks())

    return task


def _windows(width: int):
    """(digit, block, n, at, window): each window of a run by a hash of all its bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("bytes"))
            for row in range(batch.num_rows):
                d = data[offsets[row] : offsets[row + 1]]
                sums = np.zeros(len(d) + 1, np.uint64)
                np.cumsum(BYTE_CODES[d] * powers(BASE, len(d)), out=sums[1:])
                k = len(d) - width + 1
                window = mix((sums[width:] - sums[:k]) * powers(BASE_INVERSE, len(d) + 1)[:k])
                same = pa.array(np.full(k, row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in ("digit", "block", "n")), pa.array(np.arange(k)), pa.array(window.view(np.int64))], ["digit", "block", "n", "at", "window"])

    return task


def _dealt_again(runs: DataFrame, width: int) -> DataFrame:
    """(digit, block, from, to) for groups too large for a task: counts of windows, then neighbours in a run joined up."""
    each = stored(runs.mapInArrow(_windows(width), "digit bigint, block bigint, n bigint, at bigint, window bigint"), "repeat-windows")
    twice = stored(each.groupBy("digit", "window").agg(F.sum("n").alias("copies")).where("copies > 1").drop("copies"), "repeat-twice")
    found = each.where("n = 1").join(twice, ["digit", "window"])
    place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("at"))  # a run's windows, at most STRETCH
    return found.withColumn("island", F.col("at") - place).groupBy("digit", "block", "island").agg(F.min("at").alias("from"), (F.max("at") + 1).alias("to")).drop("island")


def find_repeats(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, key, spans): the bytes of each text that a repeated window of ``width`` bytes covers.

    ``spans`` are pairs of places that may overlap; ``key`` is xxhash64 of the text, as doc_id may repeat. Texts without a
    repeated window have no row. A window repeats if the same bytes also start at another place of the same text or of
    another row's, be it of the same doc_id. Null texts are empty; extra columns are not read.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    digits = stored(rows.mapInArrow(_first_digits(width), f"doc_id {id_type}, key bigint, digit bigint, n bigint"), "repeat-digits")
    alive = stored(digits.groupBy("digit").agg(F.sum("n").alias("n")).where("n > 1").drop("n"), "repeat-alive")
    own = stored(digits.join(alive, "digit").groupBy("doc_id", "key").agg(F.collect_set("digit").alias("digits")), "repeat-own")  # at most a text's own
    release(digits, alive)
    again = let_through(rows, own.select("doc_id", "key"), ["doc_id", "key"], True)
    same = (again["key"] == own["key"]) & again["doc_id"].eqNullSafe(own["doc_id"])
    again = again.join(own, same).select(again["doc_id"], again["key"], "text", "digits")
    kinds = f"doc_id {id_type}, key bigint, start bigint, length bigint, digit bigint, block bigint, bytes binary"
    runs = stored(again.mapInArrow(_cut_runs(width), kinds), "repeat-runs")
    release(own)
    blocks = stored(runs.groupBy("digit", "block").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"), F.first("bytes").alias("bytes")), "repeat-blocks")
    groups = blocks.groupBy("digit").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("copies"), F.sum(F.octet_length("bytes")).alias("size"))
    groups = stored(groups.where("blocks > 1 or copies = 1").select("digit", "size"), "repeat-groups")
    asked = blocks.join(groups, "digit")
    small = asked.where(F.col("size") <= group_bytes).drop("size").repartition("digit").sortWithinPartitions("digit")
    marks = blocks.where("n > 1").select("digit", "block", F.lit(0).cast("bigint").alias("from"), F.col("length").alias("to"))
    marks = marks.union(small.mapInArrow(_finish(width), "digit bigint, block bigint, from bigint, to bigint"))
    marks = marks.union(_dealt_again(asked.where(F.col("size") > group_bytes), width).select("digit", "block", "from", "to"))
    marks = stored(marks, "repeat-marks")
    release(blocks, groups)
    span = F.struct((F.col("start") + F.col("from")).alias("from"), (F.col("start") + F.col("to") + width - 1).alias("to"))
    places = runs.select("doc_id", "key", "start", "digit", "block").join(marks, ["digit", "block"]).select("doc_id", "key", span.alias("span"))
    found = stored(places.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("span")).alias("spans")), "repeat-spans")
    release(runs, marks)
    return found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch.column("text"))
        lists = batch.column("spans")
        at, flat = lists.offsets.to_numpy(), lists.flatten()
        begin, end = (flat.field(c).to_numpy() - 0 for c in ("from", "to"))
        at = at - at[0]
        kept, spans = [], []
        for row in range(batch.num_rows):
            text = data[offsets[row] : offsets[row + 1]]
            a, b = begin[at[row] : at[row + 1]], end[at[row] : at[row + 1]]
            if len(a):  # sorted by begin: a span that begins behind all ends before it opens a new one
                far = np.maximum.accumulate(b)
                new = np.concatenate([[True], a[1:] > far[:-1]])
                a, b = a[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"from": x, "to": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        kinds = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, kinds), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = WIDTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row: the removed runs of bytes, and the bytes that are left.

    All bytes that a window of ``width`` bytes covers go if the same bytes start anywhere else, judged on the input; what is
    left may end within a character, so ``kept`` is binary. Null texts are empty; texts shorter than ``width`` stay; each of
    several rows with a doc_id is a text of its own, so equal rows remove each other. An empty table gives an empty result.
    ``width`` is 16 at least. Only texts with a span are shuffled, and the few others that the bitmap lets through.
    """
    if width < 16:
        raise ValueError("a window has 16 bytes at least")
    found = find_repeats(docs, width, group_bytes)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    ids = found.select("doc_id", "key")
    kind = "array<struct<from: bigint, to: bigint>>"
    whole = let_through(rows, ids, ["doc_id", "key"], False).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.array().cast(kind).alias("spans"), F.col("text").alias("kept"))
    asked = let_through(rows, ids, ["doc_id", "key"], True)
    same = (asked["key"] == found["key"]) & asked["doc_id"].eqNullSafe(found["doc_id"])
    touched = asked.join(found, same, "left").select(asked["doc_id"], "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    cut = touched.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, spans {kind}, kept binary")
    return whole.union(cut)


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """A row per document: its bytes, those in a passage of 200 bytes found twice, the runs of these, and what is left."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
