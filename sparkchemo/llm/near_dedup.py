"""MinHash near-dedup with an LSH forest.

A text is its set of word shingles. Texts with equal sets are one class, and only a
class's smallest document goes on. Each representative has several sorted signature
orders (trees). Documents that share ROOT values at the front of an order form a region.
Small regions are compared whole. In crowded ones a document first meets those with the
longest common prefix, its neighbours in the order, and the hubs of the region. Links are
confirmed on full sets and make components; crowded regions that hold several of these
are then compared again, by signatures and after that by full sets, in blocks, so that no
pair of different components in a region goes unseen. Where too many documents are left
for that, the prefix grows until it is as long as the region needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.llm.common import release, stored
from sparkchemo.llm.components import components
from sparkchemo.llm.textkit import Words, mix, shingle_hashes, slices, texts

WIDTH = 5
#: Orders, values in each, and the values that a region shares at least.
TREES, DEPTH, ROOT = 16, 8, 4
#: Regions of at most SMALL documents are compared whole, larger ones in blocks of about HUGE.
SMALL, HUGE = 16, 512
#: Neighbours before a document in the order, and hubs of its region, that it is compared with first.
REACH, HUBS = 8, 4
#: A region with more than HUGE unlinked documents is split by two further values, in WAYS different choices of the two
#: (a pair at 0.8 shares one of them with a probability of 0.95, and meets in seven regions on average), up to LEVELS times.
WAYS, LEVELS = 3, 2
#: Share of equal signature bytes below which a pair is not confirmed: five standard deviations
#: (0.032 at 128 values) under the threshold's expectation.
MARGIN = 0.16
#: Pairs whose texts one task compares with the same text.
SALT = 256
#: log2 of the bits of a bitmap of ids (8 MB): with more ids it lets more texts through, and the join decides.
BITS = 26
SLICE = 2 << 20
_SALT = mix(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, i: int, j: int, width: int) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of texts i..j-1."""
    w = Words(data, offsets, i, j)
    h = w.hashes()
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        yield np.unique(shingle_hashes(h[a:b], width))


def signature(u: np.ndarray, size: int = TREES * DEPTH) -> np.ndarray:
    """``size`` minima of different scramblings of a set's hashes."""
    x, a = _SALT[:size, None], _SALT[size : 2 * size, None] | np.uint64(1)
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(u), 2048):
        out = np.minimum(out, (((u[None, k : k + 2048] ^ x) * a) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


def _describe(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            n, digest, roots, marks = [], [], [], []
            for i, j in slices(offsets, SLICE):
                for u in shingle_sets(data, offsets, i, j, width):
                    n.append(len(u))
                    if not len(u):
                        digest.append(None)
                        roots.append(None)
                        marks.append(None)
                        continue
                    digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                    s = signature(u).reshape(TREES, DEPTH).astype(np.uint64)
                    root = mix(np.arange(TREES, dtype=np.uint64))
                    for d in range(ROOT):
                        root = mix(root ^ s[:, d] * np.uint64(0x9E3779B97F4A7C15))
                    roots.append(root.view(np.int64))
                    marks.append((s & np.uint64(255)).astype(np.uint8).tobytes())
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip((n, digest, roots, marks), kinds, strict=True))],
                ["doc_id", "n_shingles", "digest", "roots", "marks"],
            )

    return task


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one == two).mean(1)


def _bytes(column: pa.Array) -> np.ndarray:
    """A matrix of a binary column whose values are equally long."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agree(least: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                batch = batch.filter(pa.array(_agreement(_bytes(batch.column("marks_a")), _bytes(batch.column("marks_b"))) >= least))
            yield batch.select(["a", "b"])

    return task


def small_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs, alike enough in size, of each region of at most SMALL documents; ``shared`` has region, doc_id, n, size."""
    groups = shared.where(F.col("size") <= SMALL).groupBy("region").agg(F.array_sort(F.collect_set(F.struct("doc_id", "n"))).alias("m"))
    first = groups.select("m", F.posexplode("m").alias("at", "x"))
    pairs = first.select("x", F.explode(F.slice("m", F.col("at") + 2, SMALL)).alias("y"))
    return pairs.where(_fits(F.col("x.n"), F.col("y.n"), percent) & (F.col("x.doc_id") != F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def _neighbours(least: float, percent: int):
    """The best of the REACH documents before each one in its region's order, if alike enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        region, doc, n, marks = none, none, none, np.zeros((0, TREES * DEPTH), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("region", "doc_id", "n")]
            region, doc, n = (np.concatenate([x[-REACH:], y]) for x, y in zip((region, doc, n), new, strict=True))
            marks = np.concatenate([marks[-REACH:], _bytes(batch.column("order"))])
            lead = len(doc) - batch.num_rows
            best, partner = np.zeros(len(doc)), np.full(len(doc), -1)
            for k in range(1, REACH + 1):
                at = np.arange(max(lead, k), len(doc))
                at = at[(region[at] == region[at - k]) & (doc[at] != doc[at - k])]
                at = at[100 * np.minimum(n[at], n[at - k]) >= percent * np.maximum(n[at], n[at - k])]
                same = _agreement(marks[at], marks[at - k])
                won = same > best[at]
                best[at[won]], partner[at[won]] = same[won], at[won] - k
            at = np.flatnonzero(best >= least)
            one, two = doc[at], doc[partner[at]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    return task


def _with_hubs(least: float):
    """The best of its region's hubs for each document, if alike enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs = batch.column("hubs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(hubs.offsets.to_numpy()))
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(row):
                flat = hubs.flatten()
                doc, hub = batch.column("doc_id").to_numpy()[row], flat.field("doc_id").to_numpy()
                same = np.where(doc == hub, 0.0, _agreement(_bytes(batch.column("order"))[row], _bytes(flat.field("order"))))
                order = np.lexsort((hub, -same, row))
                first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
                first = first[same[first] >= least]
                a, b = np.minimum(doc[first], hub[first]), np.maximum(doc[first], hub[first])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return task


def crowded_rows(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """(region, doc_id, n, order) of regions larger than SMALL; ``order`` is the signature from the tree's values behind the root round to its begin."""
    crowd = shared.where(F.col("size") > SMALL).join(reps.select("doc_id", "roots", "marks"), "doc_id")
    place = (F.array_position("roots", F.col("region")) - 1) * DEPTH + ROOT
    order = F.concat(F.substring("marks", place.cast("int") + 1, F.lit(TREES * DEPTH)), F.substring("marks", F.lit(1), place.cast("int")))
    return crowd.where(F.array_contains("roots", F.col("region"))).select("region", "doc_id", "n", order.alias("order"))


def crowded_pairs(crowd: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document with its best neighbour in the order and its region's best hub.

    Rows are dealt by range of the order, so a region of any size is spread over tasks. The
    hubs are the least documents of the commonest continuations of a region: variants of one
    text that leave it at the same depth sort next to each other, away from the text itself.
    """
    least = percent / 100 - MARGIN
    lined = crowd.repartitionByRange("region", "order", "doc_id").sortWithinPartitions("region", "order", "doc_id")
    near = lined.mapInArrow(_neighbours(least, percent), "a bigint, b bigint")
    branches = crowd.groupBy("region", F.substring("order", 1, 8).alias("branch")).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc_id", "order")).alias("hub"))
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("size"), "hub.doc_id"))
    hubs = branches.where("size > 1").withColumn("rank", rank).where(F.col("rank") <= HUBS).groupBy("region").agg(F.collect_list("hub").alias("hubs"))
    hubs = stored(hubs, "near-hubs")  # a scan on this side lets the planner split a hot region's join
    bridged = crowd.join(hubs, "region").select("doc_id", "order", "hubs").mapInArrow(_with_hubs(least), "a bigint, b bigint")
    return near.union(bridged)


def _one_by_one(width: int, percent: int):
    """Texts of ``a`` come first (kind 0), then those of the documents to compare it with."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        of, begun = None, False
        for batch in batches:
            data, offsets = texts(batch.column("text"))
            a, b, kind = (batch.column(c).fill_null(-1).to_numpy() for c in ("a", "b", "kind"))
            good = []
            for i, j in slices(offsets, SLICE):
                for k, u in zip(range(i, j), shingle_sets(data, offsets, i, j, width), strict=True):
                    if kind[k] == 0:
                        # Rows that share a doc_id are one document: any of their texts will do.
                        held = [*held, u] if of == a[k] and not begun else [u]
                        of, begun = a[k], False
                    elif of == a[k]:
                        begun = True
                        for own in held:
                            same = len(np.intersect1d(own, u, assume_unique=True))
                            if 100 * same >= percent * (len(own) + len(u) - same):
                                good.append(k)
                                break
            good = np.array(good, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return task


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that a bitmap of ``ids`` (doc_id) lets through: all that are asked for, and a few others.

    The bitmap has 2 ** BITS bits at any size of the corpus, so it can be broadcast; it
    keeps most other texts out of the shuffle of the join that follows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    bits = ids.select(slot(F.col("doc_id")).alias("slot")).groupBy(F.floor(F.col("slot") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.floor(slot(F.col("doc_id")) / 32768).alias("bucket"), (slot(F.col("doc_id")) % 32768).alias("bit"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(stored(bits, "near-bitmap")), "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select("doc_id", "text")


def confirm_pairs(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are alike: 100 * intersection >= percent * union.

    In each pair the document with more partners is the one whose set stays in a task while
    the others stream past, so a text travels at most sqrt(2 * pairs) times as the other, and
    the partners of one document are dealt in parts of about SALT.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stored(both.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-degrees")
    of = lambda c: degree.select(F.col("a").alias(c), F.col("n").alias(f"n_{c}"))
    turned = pairs.join(of("a"), "a").join(of("b"), "b")
    keep = F.struct("n_a", F.col("a")) >= F.struct(F.col("n_b"), F.col("b").alias("a"))
    ways = F.ceil(F.greatest("n_a", "n_b") / SALT).cast("int")
    dealt = stored(turned.select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("b"), ways.alias("ways")), "near-turned")
    text = texts_of(docs, degree.select(F.col("a").alias("doc_id"))).withColumnRenamed("doc_id", "id")
    none = F.lit(None).cast("bigint")
    # The pairs grow with the corpus: both joins deal them out, at any size.
    second = text.join(dealt.hint("shuffle_hash"), F.col("b") == F.col("id")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).cast("int").alias("way"), F.lit(1).alias("kind"), "text")
    heads = dealt.groupBy("a").agg(F.max("ways").alias("ways"))
    first = text.join(heads.hint("shuffle_hash"), F.col("a") == F.col("id")).select("a", none.alias("b"), F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.lit(0).alias("kind"), "text")
    rows = first.union(second).repartition("a", "way").sortWithinPartitions("a", "way", "kind")
    found = stored(rows.mapInArrow(_one_by_one(width, percent), "a bigint, b bigint"), "near-links")
    release(degree, dealt)
    return found


def open_regions(crowd: DataFrame) -> DataFrame:
    """Rows of the regions of ``crowd`` (region, doc_id, n, order, c) that hold several components ``c``.

    Added: ``size`` of the region, and ``odd``: whether a document is outside the region's
    largest component; ``odds`` counts these.
    """
    by = crowd.groupBy("region", "c").agg(F.count(F.lit(1)).alias("k"))
    most = by.groupBy("region").agg(F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("most")).where("size > most.k")
    most = stored(most.select("region", "size", F.col("most.c").alias("main"), (F.col("size") - F.col("most.k")).alias("odds")), "near-open")
    return crowd.join(most, "region").withColumn("odd", F.col("c") != F.col("main")).drop("main")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` of ``open_regions`` as block pairs: (region, p, q) with doc_id, n, order, c and ``asks``.

    Each odd document meets all of its region: the region is cut into parts p of about HUGE
    and the odd documents into parts q, and every (p, q) is a group of at most about 2 * HUGE.
    """
    p, q = (F.ceil(F.col(c) / HUGE).cast("int") for c in ("size", "odds"))
    own_p, own_q = F.pmod(F.xxhash64("doc_id"), p).cast("int"), F.pmod(F.xxhash64("doc_id", F.lit(1)), q).cast("int")
    place = lambda i, j, asks: F.struct(i.alias("p"), j.alias("q"), asks.alias("asks"))
    as_all = F.transform(F.sequence(F.lit(0), q - 1), lambda j: place(own_p, j, F.col("odd") & (j == own_q)))
    as_odd = F.transform(F.filter(F.sequence(F.lit(0), p - 1), lambda i: i != own_p), lambda i: place(i, own_q, F.lit(True)))
    spread = rows.withColumn("at", F.explode(F.when(F.col("odd"), F.concat(as_all, as_odd)).otherwise(as_all)))
    return spread.select("region", "at.p", "at.q", "at.asks", "doc_id", "n", "order", "c")


def _survivors(least: float, percent: int):
    """The documents of a block pair that have a partner of another component, alike enough by signature and size."""

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, n, c = (table.column(x).to_numpy() for x in ("asks", "n", "c"))
        marks = _bytes(table.column("order").chunk(0)) if table.num_rows else np.zeros((0, 1), np.uint8)
        live = np.zeros(len(n), bool)
        for k in np.flatnonzero(asks).tolist():
            other = np.flatnonzero((c != c[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])))
            hit = other[_agreement(marks[other], marks[k][None]) >= least]
            live[hit] = True
            live[k] |= len(hit) > 0
        return table.filter(pa.array(live)).select(["region", "p", "q", "asks", "doc_id", "c"])

    return task


def _exact(width: int, percent: int):
    """Links between different components of a block pair, by full sets; only as many as connect them."""

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, c, asks = (table.column(x).to_numpy() for x in ("doc_id", "c", "asks"))
        data, offsets = texts(table.column("text"))
        sets = [u for i, j in slices(offsets, SLICE) for u in shingle_sets(data, offsets, i, j, width)]
        n = np.array([len(u) for u in sets])
        same = shared_counts(sets, np.flatnonzero(asks))
        root = {k: k for k in c.tolist()}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for row, k in enumerate(np.flatnonzero(asks).tolist()):
            for other in np.flatnonzero(100 * same[row] >= percent * (n[k] + n - same[row])).tolist():
                one, two = find(int(c[k])), find(int(c[other]))
                if one != two:
                    root[max(one, two)] = min(one, two)
                    links.append((min(doc[k], doc[other]), max(doc[k], doc[other])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return task


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, wide: int = 4096) -> np.ndarray:
    """[rows, sets]: sizes of the intersections of some sets with all, by products of incidence matrices, ``wide`` shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    _, key, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[key] > 1  # a shingle of one set is in no intersection but its own
    key, owner = np.unique(key[often], return_inverse=True)[1], owner[often]
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    out = np.zeros((len(rows), len(sets)))
    for at in range(0, int(key[-1]) + 1 if len(key) else 0, wide):
        a, b = np.searchsorted(key, [at, at + wide])
        x = np.zeros((len(sets), wide), np.float32)
        x[owner[a:b], key[a:b] - at] = 1
        out += x[rows] @ x.T
    return out


def complete(docs: DataFrame, crowd: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(a, b): the links that ``found`` (id, component) still lacks in crowded regions; None if no region is open."""
    named = crowd.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("region", "doc_id", "n", "order", F.coalesce("component", "doc_id").alias("c"))
    rows, parts = stored(open_regions(named), "near-rows"), []
    used = [rows]
    for level in range(LEVELS + 1):
        last = level == LEVELS
        parts.append(in_blocks(rows if last else rows.where(F.col("odds") <= HUGE)))
        deep = rows.where(F.col("odds") > HUGE)
        if last or deep.isEmpty():
            break
        # Longer prefixes: two further values of the signature, chosen in several ways.
        pairs = F.array(*[F.concat(F.substring("order", 2 * (level * WAYS + k) + 1, 2), F.lit(k).cast("string").cast("binary")) for k in range(WAYS)])
        longer = deep.withColumn("more", F.explode(pairs)).select(F.xxhash64("region", "more").alias("region"), "doc_id", "n", "order", "c")
        rows = stored(open_regions(longer), "near-rows")
        used.append(rows)
    blocks = parts[0]
    for part in parts[1:]:
        blocks = blocks.union(part)
    shape = "region bigint, p int, q int, asks boolean, doc_id bigint, c bigint"
    live = stored(blocks.groupBy("region", "p", "q").applyInArrow(_survivors(percent / 100 - MARGIN, percent), shape), "near-live")
    release(*used)
    if live.isEmpty():
        return None
    text = texts_of(docs, live.select("doc_id"))
    links = live.join(text, "doc_id").groupBy("region", "p", "q").applyInArrow(_exact(width, percent), "a bigint, b bigint")
    out = stored(links.distinct(), "near-more")
    release(live)
    return out


def one_document(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links of a doc_id that has several texts with these texts' classes."""
    digest = F.xxhash64("digest")
    several = sets.where("digest is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("low <> high").select("doc_id")
    own = sets.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "digest").join(reps.select("digest", F.col("doc_id").alias("b")), "digest")
    return own.where("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    different ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle).
    component_id is the smallest doc_id that links reach, kept is doc_id = component_id.

    A null or blank text has an empty set and is linked with nothing. Whole texts are read,
    however long. Rows that share a doc_id are one document with several texts, linked by any of
    them; each row comes back. An empty table gives an empty result. Other columns are not
    read. A pair is found if its signatures share the ROOT first values of one of the
    TREES orders: at 0.80 all but 0.02 %, at 0.85 all but 0.0007 %; in regions that are split
    twice for their size all but 0.06 % and 0.002 %. Every link is confirmed on full sets.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    shape = "doc_id bigint, n_shingles bigint, digest binary, roots array<bigint>, marks binary"
    sets = stored(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_describe(width), shape), "near-sets")
    # Equal sets: partial minima, so a third of all rows with one text is a row per task.
    same = sets.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("roots").alias("roots"), F.first("marks").alias("marks")
    )
    reps = stored(same, "near-classes")
    rows = reps.select(F.explode("roots").alias("region"), "doc_id", "n")
    sizes = stored(rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    shared = stored(rows.join(sizes, "region"), "near-shared")
    crowd = stored(crowded_rows(shared, reps), "near-crowd")
    pairs = small_pairs(shared, percent).distinct()
    marks = lambda c: reps.select(F.col("doc_id").alias(c), F.col("marks").alias(f"marks_{c}"))
    alike = pairs.join(marks("a"), "a").join(marks("b"), "b").select("a", "b", "marks_a", "marks_b").mapInArrow(_agree(percent / 100 - MARGIN), "a bigint, b bigint")
    likely = stored(alike.union(crowded_pairs(crowd, percent)).distinct(), "near-likely")
    release(sizes, shared)
    links = confirm_pairs(docs, likely, width, percent).union(one_document(sets, reps))
    found = components(links)
    more = complete(docs, crowd, found, width, percent)
    if more is not None:
        found = components(links.union(more))
    release(likely, crowd)
    found = found.select(F.col("id").alias("doc_id"), "component")
    # Only classes with copies or links differ from "a document of its own".
    known = reps.select("digest", "copies", "doc_id").join(found, "doc_id", "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "doc_id").alias("component"))
    out = sets.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=85)
