"""Suffix dedup, hard negatives and ranked search against brute force: odd rows, ties, repeats, hot groups, every path."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.llm import lexical_search, negatives, suffix_dedup
from tests.llm.test_operators import prose


# --- suffix dedup -----------------------------------------------------------------------------------------------


def brute_repeats(rows, width):
    seen = Counter(t[i : i + width] for _, t in rows for i in range(len(t) - width + 1))
    out = []
    for doc, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(docs, width, **options):
    rows = suffix_dedup.remove_repeats(docs, width, **options).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], hashlib.sha256(r["kept"]).hexdigest()) for r in rows), key=repr)


@pytest.mark.parametrize("width", [16, 37, 200])
def test_repeated_windows_equal_brute_force(spark, width):
    base, shared = prose(0, 400), prose(1, 60)
    words = base.split()
    words[50] = words[200] = "changed"
    texts = [base, base, " ".join(words), prose(2, 80) + shared + prose(3, 70), shared + "é" * 300, prose(4, 50) + shared, "a" * 900, "ab" * 40, "abc" * 250, None, "", "short", "é" * 150]
    texts += [base[: 60 + 37 * k] + prose(30 + k, 30) for k in range(12)] + [shared + shared, prose(5, 40) + prose(5, 40)[:width]]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(3, texts[3], "y", 0), (3, prose(6, 90), "y", 0), (None, base[:500], "z", 1), (None, prose(7, 60), "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, digit int").repartition(3)
    want = brute_repeats([(d, (t or "").encode()) for d, t, *_ in rows], width)
    assert removed(docs, width) == want
    assert removed(docs, width, group_bytes=0) == want and any(s for _, _, s, _ in want) and not all(s for _, _, s, _ in want)


def test_windows_across_stretches(spark, monkeypatch):
    """The results do not depend on where a buffer is cut."""
    rows = [(k, (prose(k % 3, 90) + prose(40 + k, 30)).encode()) for k in range(9)]
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    whole = [(r.start, r.length, r.digit) for r in suffix_dedup.stretches(data, offsets, 40)]
    windows = {s + k: d for one in whole for s, n, d in zip(*one, strict=True) for k in range(n)}
    monkeypatch.setattr(suffix_dedup, "STRETCH", 333)
    parts = {s + k: d for r in suffix_dedup.stretches(data, offsets, 40) for s, n, d in zip(r.start, r.length, r.digit, strict=True) for k in range(n)}
    assert windows == parts and len(windows) == sum(len(t) - 39 for _, t in rows)


def test_repeats_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert removed(empty, 200) == []
    alone = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 199)], "doc_id bigint, text string")
    assert all(not s for _, _, s, _ in removed(alone, 200)) and len(removed(alone, 200)) == 3
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(alone, 8)


# --- hard negatives ---------------------------------------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives_=10, low=30, high=90):
    out = []
    for a, label, v in sorted(set(anchors)):
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, m, w in rows if i != a]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            fits = sorted((t, n) for t, n, m in score if m != label and low * -s <= 100 * -t <= high * -s)[:negatives_]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("pivots", "each", "chunk"), [(64, 256, 8192), (5, 3, 16), (1, 1000, 1)])
def test_hard_negatives_equal_brute_force(spark, pivots, each, chunk):
    """Clusters, a hot vector that a third of the rows share, ties, zero and far vectors, repeated rows."""
    rng = np.random.default_rng(3)
    centers = rng.integers(-40, 40, (4, 6))
    rows = [(i, int(i % 3), tuple(int(x) for x in centers[i % 4] + rng.integers(-9, 9, 6))) for i in range(120)]
    rows += [(200 + i, int(i % 2), tuple(int(x) for x in centers[0])) for i in range(60)] + [(300, 0, (0,) * 6), (301, 1, (900, -900, 0, 0, 0, 3)), (7, 1, rows[7][2]), (10, 2, (3,) * 6), rows[20], rows[21]]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, v array<bigint>").withColumns({"w": F.lit(1), "home": F.lit("x")}).repartition(3)
    got = sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, pivots=pivots, anchors_each=each, chunk=chunk).collect()))
    want = brute_negatives(rows, [r for r in rows if r[0] % 10 == 0])
    assert got == want and len(got) > 300


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5]), (2, None, [0.1, 0.1]), (3, 1, None), (4, 1, [nan, 0.0]), (5, 1, [inf, 0.0]), (6, 1, [None, 0.0]), (None, 1, [0.1, 0.1]), (7, 0, [-0.001, 0.3])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = negatives.quantised(df, "vec_id", "label", "embedding")
    assert {r["vec_id"]: r["v"] for r in got.collect()} == {0: [128, 64], 1: [128, 0], 7: [-1, 76]}
    assert negatives.mine(got, F.col("vec_id") == 0).count() == 0  # 4736 is below 30 % of the positive's 16384
    assert negatives.mine(got.limit(0), F.lit(True)).count() == 0 and negatives.mine(got, F.lit(False)).count() == 0


def test_bounds_hold_for_every_row_of_a_cell(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, 0, rng.integers(-200, 200, 5).tolist()) for i in range(200)], "vec_id bigint, label int, v array<bigint>")
    placed, space = negatives.voronoi(df, 9)
    rows = placed.collect()
    q = rng.integers(-300, 300, (7, 5)).astype(float)
    low, high = space.bounds(q)
    for r in rows:
        s = q @ np.array(r["v"], float)
        assert (low[:, r["cell"]] <= s).all() and (s <= high[:, r["cell"]]).all()
    assert sum(space.count) == 200


# --- ranked search ----------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_search(docs, items, top):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x for *_, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        score = Counter()
        for t in terms(text):
            if not df[t]:
                continue
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            for k, (_, b, size) in enumerate(bags):
                if t in b:
                    score[k] += w * ((1000000000 * b[t]) // (1000 * b[t] + 12 * (75 + (25 * size * n) // total)))
        found = sorted((-s, bags[k][0]) for k, s in score.items() if s > 0 and bags[k][0] is not None)[:top]
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("shard_docs", "beam", "block_terms"), [(1 << 14, 16, 1 << 17), (7, 1, 40), (1, 3, 1 << 17)])
def test_search_equals_brute_force(spark, shard_docs, beam, block_terms):
    texts = [prose(k, 5 + 7 * (k % 9)) for k in range(70)] + [prose(3, 26)] * 30 + [None, "", " .,;", "ÉTÉ été Été_x9 the-of", "the " * 500, prose(5, 40).upper()]
    docs = [(k, t) for k, t in enumerate(texts)] + [(4, prose(4, 33)), (None, prose(3, 26))]
    items = [(0, prose(3, 26)), (1, "the the of " + prose(8, 6)), (2, "nowhere"), (3, None), (4, "Été THE"), (5, ""), *[(6 + k, prose(k, 12)) for k in range(9)]]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, item_id string, n int").repartition(3)
    bench = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").withColumn("term", F.lit(0))
    got = sorted(map(tuple, lexical_search.rank(df, bench, top=6, shard_docs=shard_docs, beam=beam, block_terms=block_terms).collect()))
    assert got == brute_search(docs, items, 6)


def test_search_opens_few_nodes_and_ranges_keep_their_order():
    """The best-first search leaves most of the tree closed, and a node's first posting has its greatest impact."""
    rng = np.random.default_rng(2)
    term, doc = np.divmod(np.unique(rng.integers(0, 40 * 1000, 9000)), 1000)
    impact = rng.integers(1, 1000, len(term))
    tree = lexical_search.WaveletTree(term, doc, impact, 40, 1000)
    a, b = tree.first[:-1], tree.first[1:]
    for level in range(3):
        a, b, *_ = tree.children(level, a, b)
        for x, y in zip(a, b, strict=True):
            assert (np.diff(tree.impact[level + 1][x:y]) <= 0).all()
    items = lexical_search.Items([0], np.zeros(3, np.int64), np.array([1, 2, 3]), np.array([5, 3, 1]))
    best = lexical_search.Best(1, 5)
    opened = lexical_search.search(tree, items, best, np.arange(1000))
    score = np.zeros(1000, np.int64)
    for t, w in zip((1, 2, 3), (5, 3, 1), strict=True):
        own = term == t
        score[doc[own]] += w * impact[own]
    assert best.doc.tolist() == sorted(range(1000), key=lambda d: (-score[d], d))[:5] and opened < 1000


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.rank(docs.limit(0), items).count() == lexical_search.rank(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical_search.rank(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 12 * 100)))]
