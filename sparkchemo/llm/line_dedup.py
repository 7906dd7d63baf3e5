"""Line dedup: exact reference counts per line key, screened by sharded cuckoo filters.

The index holds postings (key, doc_id), one per document and key, the exact reference
count of every key, and a cuckoo filter per shard with the keys that repeat. Inserting or
deleting documents changes the counts by the batch's keys, and the filters take in or give
up exactly the keys that begin or cease to repeat, so the dedup can be undone document by
document. Lines pass their shard's filter in a streaming pass; the few that it takes are
checked against the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import SPACES, ascii_lower, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard's filter (8 MB at most: 4 slots a bucket, 2 bytes each) and rows of a shard part.
SHARD_KEYS, PART_ROWS = 1 << 20, 1 << 20
SLOTS = 4


class CuckooFilter:
    """A set of 64-bit hashes in 16-bit fingerprints; supports add, discard and batch look-ups.

    A fingerprint lies in one of two buckets, each found from the other and the fingerprint.
    A full filter evicts along a bounded walk; what finds no place goes to ``stash``, which is
    part of the filter, so a key that was added is never missed.
    """

    def __init__(self, n: int):
        self.buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n) / SLOTS / 0.84))))
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.stash: list[int] = []

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(h, np.uint64)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, one, one ^ self._step(mark)

    def _step(self, mark):
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)).astype(np.int64) & (self.buckets - 1)

    def add(self, hashes: np.ndarray) -> None:
        mark, one, two = self._places(hashes)
        table, rng = self.table, np.random.default_rng(len(hashes))
        for m, a, b in zip(mark.tolist(), one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = m
                    break
            else:
                at = a
                for _ in range(200):
                    k = int(rng.integers(SLOTS))
                    m, table[at, k] = int(table[at, k]), m
                    at ^= int(self._step(np.array([m], np.uint16))[0])
                    free = np.flatnonzero(table[at] == 0)
                    if len(free):
                        table[at, free[0]] = m
                        break
                else:
                    self.stash.append(m)

    def discard(self, hashes: np.ndarray) -> None:
        """Take out hashes that were added."""
        for m, *places in zip(*(x.tolist() for x in self._places(hashes)), strict=True):
            for at in places:
                held = np.flatnonzero(self.table[at] == m)
                if len(held):
                    self.table[at, held[0]] = 0
                    break
            else:
                self.stash.remove(m)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(hashes)
        out = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        return out | np.isin(mark, self.stash) if self.stash else out

    def to_bytes(self) -> bytes:
        return np.array([self.buckets, len(self.stash)], np.int64).tobytes() + np.array(self.stash, np.uint16).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.buckets, n = (int(x) for x in np.frombuffer(data, np.int64, 2))
        out.stash = np.frombuffer(data, np.uint16, n, 16).tolist()
        out.table = np.frombuffer(data, np.uint16, out.buckets * SLOTS, 16 + 2 * n).reshape(out.buckets, SLOTS).copy()
        return out


def line_key(line: Column) -> Column:
    r"""The line without ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc_id): a row for each document and different key of enough characters; 128 bits stand for a key."""
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    long = F.filter(keys, lambda k: F.length(k) >= min_chars)
    pairs = F.array_distinct(F.transform(long, lambda k: F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(k, F.lit(7)).alias("k2"))))
    return docs.select("doc_id", F.explode(pairs).alias("k")).select("k.k1", "k.k2", "doc_id")


@dataclass(frozen=True)
class LineIndex:
    """The reversible index, as tables; an index that changes gives a new one.

    ``postings`` (k1, k2, doc_id), ``counts`` (k1, k2, n_docs, keeper: the largest doc_id)
    of every key, ``filters`` (shard, slots, filter) of the keys in at least ``min_docs``
    documents; a key's shard is k1 modulo ``shards``.
    """

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        rows = postings(docs, min_chars)
        rows = stored(rows.distinct() if _repeats(docs) else rows, "line-postings")
        # Partial sums come first, so a line of a third of all documents is a row per task.
        counts = stored(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")), "line-counts")
        return cls(rows, counts, counts, 1, min_chars, min_docs)._rebuilt()

    def repeated(self) -> DataFrame:
        """``counts`` of the keys that lose lines, with their ``shard``."""
        return self.counts.where(F.col("n_docs") >= self.min_docs).withColumn("shard", self._shard())

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards)).cast("int")

    def _rebuilt(self) -> LineIndex:
        """With filters built anew, in as many shards as the repeated keys need."""
        new = replace(self, shards=max(1, -(-self.repeated().count() // SHARD_KEYS)))
        return replace(new, filters=stored(new.repeated().select("k1", "shard").groupBy("shard").applyInArrow(_build_filter, FILTER), "line-filters"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """With ``docs`` (doc_id, text) too; what is there already changes nothing."""
        keys = ["k1", "k2"]
        batch = stored(postings(docs, self.min_chars).distinct().join(self.postings, [*keys, "doc_id"], "left_anti"), "line-batch")
        delta = batch.groupBy(keys).agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("top"))
        both = self.counts.join(delta, keys, "full_outer").select(*keys, F.coalesce("n_docs", F.lit(0)).alias("before"), (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("keeper", "top").alias("keeper"))
        return self._changed(stored(self.postings.union(batch), "line-postings"), stored(both, "line-counts"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of ``ids`` (doc_id); their lines' counts fall back to what they were."""
        keys = ["k1", "k2"]
        ids = ids.select("doc_id").distinct()
        rest = stored(self.postings.join(ids, "doc_id", "left_anti").select(*keys, "doc_id"), "line-postings")
        delta = self.postings.join(ids, "doc_id", "left_semi").groupBy(keys).agg(F.count(F.lit(1)).alias("less"), F.max("doc_id").alias("top"))
        both = stored(self.counts.join(delta, keys, "left").select(*keys, F.col("n_docs").alias("before"), (F.col("n_docs") - F.coalesce("less", F.lit(0))).alias("n_docs"), "keeper", (F.col("top") == F.col("keeper")).alias("lost")), "line-counts")
        # Keys that lost their keeper find the next one among the postings that are left.
        heirs = rest.join(both.where("lost and n_docs > 0").select(keys), keys, "left_semi").groupBy(keys).agg(F.max("doc_id").alias("heir"))
        return self._changed(rest, stored(both.join(heirs, keys, "left").select(*keys, "before", "n_docs", F.coalesce("heir", "keeper").alias("keeper")), "line-counts"))

    def _changed(self, rows: DataFrame, counts: DataFrame) -> LineIndex:
        """The index after a batch; ``counts`` also has each key's count ``before``."""
        new = replace(self, postings=rows, counts=counts.where("n_docs > 0").select("k1", "k2", "n_docs", "keeper"))
        sizes = stored(new.repeated().groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "line-sizes")
        if (sizes.agg(F.sum("n")).first()[0] or 0) > 2 * self.shards * SHARD_KEYS:
            return new._rebuilt()
        # A filter too small for its keys, or a new shard's, is built from the counts; the others change in place.
        small = sizes.join(self.filters.select("shard", "slots"), "shard", "left").where("slots is null or n > 0.9 * slots").select("shard")
        built = new.repeated().select("k1", "shard").join(small, "shard", "left_semi").groupBy("shard").applyInArrow(_build_filter, FILTER)
        crossed = counts.where((F.col("before") >= self.min_docs) != (F.col("n_docs") >= self.min_docs)).select(self._shard().alias("shard"), "k1", (F.col("n_docs") >= self.min_docs).alias("enters"))
        kept = self.filters.join(small, "shard", "left_anti").groupBy("shard")
        changed = kept.cogroup(crossed.join(small, "shard", "left_anti").groupBy("shard")).applyInArrow(_change_filter, FILTER)
        return replace(new, filters=stored(built.union(changed), "line-filters"))

    def dropped(self) -> DataFrame:
        """(k1, k2, doc_id): postings whose lines go, all but the largest doc_id of each key."""
        taken = screen(self.postings.withColumn("shard", self._shard()), self.filters.select("shard", "filter"), self.shards)
        return taken.join(self.repeated(), ["k1", "k2"]).where(F.col("doc_id") < F.col("keeper")).select("k1", "k2", "doc_id")


FILTER = "shard int, slots bigint, filter binary"


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id has more than one row."""
    return bool(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([made.buckets * SLOTS], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})


def _build_filter(table: pa.Table) -> pa.Table:
    """A shard's filter from its keys, with room for half as many more."""
    keys = table.column("k1").to_numpy().view(np.uint64)
    made = CuckooFilter(3 * len(keys) // 2)
    made.add(keys)
    return _filter_row(table.column("shard")[0].as_py(), made)


def _change_filter(held: pa.Table, crossed: pa.Table) -> pa.Table:
    """A shard's filter with the keys that begin to repeat and without those that cease to."""
    if not held.num_rows:
        return held.select(["shard", "slots", "filter"])
    made = CuckooFilter.from_bytes(held.column("filter")[0].as_py())
    keys, enters = crossed.column("k1").to_numpy().view(np.uint64), crossed.column("enters").to_numpy(zero_copy_only=False).astype(bool)
    made.discard(keys[~enters])
    made.add(keys[enters])
    return _filter_row(held.column("shard")[0].as_py(), made)


def screen(lines: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Rows of ``lines`` (k1, k2, doc_id, shard) that their shard's filter takes.

    Shards are cut into parts by doc_id so that none has many more than PART_ROWS rows; a
    part's filter comes first in its task and then its lines stream past, so a task holds
    one filter and one Arrow batch however hot a key is.
    """
    sizes = lines.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", (F.floor(F.col("n") / PART_ROWS) + 1).cast("int").alias("parts"))
    ways = stored(sizes, "line-ways")  # one row a shard: at most the keys / SHARD_KEYS
    dealt = lines.join(F.broadcast(ways), "shard") if shards <= 1 << 16 else lines.join(ways, "shard")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    copies = filters.join(ways, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = F.lit(None)
    both = dealt.select("shard", "part", F.lit(1).alias("kind"), "k1", "k2", "doc_id", none.cast("binary").alias("filter")).union(
        copies.select("shard", "part", F.lit(0).alias("kind"), none.cast("bigint"), none.cast("bigint"), none.cast("bigint"), "filter")
    )
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_screen, "k1 bigint, k2 bigint, doc_id bigint")


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, of = None, None
    for batch in batches:
        kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
        filters = batch.column("filter")
        k1 = batch.column("k1").fill_null(0).to_numpy().view(np.uint64)
        keep = np.zeros(batch.num_rows, bool)
        begins = [0, *np.flatnonzero(kind == 0).tolist(), batch.num_rows]
        for a, b in zip(begins, begins[1:], strict=False):
            if a < b and kind[a] == 0:
                held, of = CuckooFilter.from_bytes(filters[a].as_py()), shard[a]
                a += 1
            # A shard whose keys never repeat has no filter, and none of its lines pass.
            own = slice(a, b)
            keep[own] = held.holds(k1[own]) & (shard[own] == of) if held is not None and a < b else False
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("k1", "k2", "doc_id")], ["k1", "k2", "doc_id"])


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines and n_dropped added.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays only
    in the largest doc_id that holds it; there, and for all other lines, every line stays.
    ``index`` is the index of these documents if there is one already; it has its own limits.

    Null and empty texts are one empty line, and come out as they were. Very long texts are
    whole. Rows that share a doc_id count as one document and are treated alike. An empty
    table gives an empty result. Columns named n_lines or n_dropped are replaced.
    """
    index = index or LineIndex.of(docs.select("doc_id", "text"), min_chars, min_docs)
    docs = docs.drop("n_lines", "n_dropped")
    name = "_lost"
    while name in docs.columns:
        name += "_"
    lost = index.dropped().groupBy("doc_id").agg(F.collect_list("k1").alias(name))  # at most a document's lines
    docs = docs.withColumns({"n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint"), "n_dropped": F.lit(0).cast("bigint")})
    joined = docs.join(lost.hint("shuffle_hash"), "doc_id", "left").select(*docs.columns, name)
    return joined.mapInArrow(_drop_lines(index.min_chars), docs.schema)


def _drop_lines(min_chars: int):
    space, seed = SPACES.encode(), 42  # the seed of Spark's xxhash64

    def one(text: str, lost: set[int]) -> list[str]:
        kept = []
        for line in text.split("\n"):
            key = line.encode().strip(space).lower()
            if len(key) >= min_chars and xxhash.xxh64_intdigest(key, seed) in lost and len(key.decode()) >= min_chars:
                continue
            kept.append(line)
        return kept

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[:-1]
            columns = {n: batch.column(n) for n in names}
            hit = np.flatnonzero(batch.column(len(names)).is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                text, dropped = columns["text"].to_pylist(), columns["n_dropped"].to_numpy().copy()
                for i in hit.tolist():
                    lost = batch.column(len(names))[i].values.to_numpy().view(np.uint64)
                    kept = one(text[i], set(lost.tolist()))
                    dropped[i] = text[i].count("\n") + 1 - len(kept)
                    text[i] = "\n".join(kept)
                columns["text"] = pa.array(text, batch.schema.field("text").type)
                columns["n_dropped"] = pa.array(dropped)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return task


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that three or more share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id
"""
}
