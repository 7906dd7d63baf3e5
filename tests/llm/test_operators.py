"""The training-data operators against SQL and brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkchemo.llm import decontaminate, language, line_dedup, lm_score, near_dedup, packing, quality_model, quality_rules, sharding, url_filter
from sparkchemo.llm.components import components
from sparkchemo.llm.queries import ORACLE_SQL, QUERIES
from sparkchemo.llm.textkit import Words, shingle_hashes
from tests.oracle import assert_same, views

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SPACE = b" \t\n\x0b\f\r"
WORDS = "the of and thing eren onst anwh blely torea shent ouan ered tion inth atre hale wheren".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(60)) for k in rng.integers(len(WORDS), size=n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, exact and near copies, a shared line, and columns whose names clash with the operators' own."""
    base = prose(0, 200)
    near = base.split()
    near[7] = "changed"
    shared = "A line that many of these documents share\n"
    texts = [base, base, " ".join(near), base.upper(), None, "", " \t\n", "one", "one two three four", "one two three four", "\u00e9t\u00e9 \u00a0 nbsp\x0bx", "123 456"]
    texts += [shared + prose(k, 60) + "\n  " + shared.upper() for k in range(1, 6)] + [prose(9, 9000)] + [prose(20 + k, 80) for k in range(8)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", 1, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_lines int, label string, size int").repartition(3)


@pytest.fixture(scope="module")
def plain(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text) -> list[bytes]:
    return (text or "").encode().lower().split() if text else []


@tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark):
    assert_same(QUERIES[name](spark, FOLDER), ORACLE_SQL[name], views(FOLDER))


def test_words_and_hashes_of_a_buffer():
    texts = [b"", b"a b", b"  A\tb ", b"x", b"a b", b"\xc3\xa9 \n"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    w = Words(data, offsets, 0, len(texts))
    h = w.hashes()
    own = [h[a:b].tolist() for a, b in zip(w.first, w.first[1:], strict=False)]
    assert [len(x) for x in own] == [0, 2, 2, 1, 2, 1]
    assert own[1] == own[2] == own[4] and own[3] != own[5]
    assert len(shingle_hashes(np.arange(9, dtype=np.uint64), 5)) == 5 and len(shingle_hashes(np.arange(3, dtype=np.uint64), 5)) == 1


def brute_components(plain, percent):
    sets = {}
    for i, t in plain.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs, plain):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert got == brute_components(plain, 85)
    assert near_dedup.near_duplicates(docs.limit(0), 85).count() == 0


def crowded(seed: int, n: int, size: int, most: int, bases: int = 1) -> list[tuple[int, str]]:
    """Variants of ``bases`` texts that share their first half, each with up to ``most`` words replaced."""
    rng = np.random.default_rng(seed)
    half, rows = prose(seed, size // 2), []
    whole = [(half + " " + prose(seed + 1 + b, size - size // 2)).split() for b in range(bases)]
    for i in range(n):
        w = list(whole[i % bases])
        for k in rng.integers(size, size=int(rng.integers(0, most + 1))):
            w[k] = f"new{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("huge", [512, 40])
@pytest.mark.parametrize("case", [(5, 260, 150, 3), (6, 300, 150, 9), (7, 200, 100, 2, 4)])
def test_near_duplicates_in_a_crowded_region(spark, monkeypatch, case, huge):
    """Copies, variants about the threshold, and families that share half: no link is lost, in one block or in many."""
    monkeypatch.setattr(near_dedup, "HUGE", huge)
    rows = crowded(*case)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect()}
    assert got == brute_components(dict(rows), 85)


def test_near_duplicates_with_repeated_ids(spark):
    """Rows that share a doc_id are one document: linked by any of their texts."""
    one, two = prose(1, 100), prose(2, 100)
    rows = [(5, one), (5, two), (5, one), (3, two), (9, one), (7, prose(4, 100))]
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 85).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 5, 80, 200, 1)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[1:3]]
    got = near_dedup.shared_counts(sets, np.array([1, 2]), wide=37)
    # A set's count with itself leaves out what no other set holds; it is never asked for.
    assert all(got[r][k] == want[r][k] for r in range(2) for k in range(5) if k != r + 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3)] + [(300, 300 + k) for k in range(1, 40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 200: 200, **dict.fromkeys(range(300, 340), 300)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_suffix_automaton_and_parse():
    text = b"abcabxabcd"
    go = language.suffix_automaton(list(text))

    def inside(w):
        s = 0
        for c in w:
            if c not in go[s]:
                return False
            s = go[s][c]
        return True

    assert all(inside(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert not inside(b"xx") and not inside(b"dc")
    samples = {"p": b"abcab abcd bca", "q": b"zzyzx zyx"}
    parser = language.CrossParser.fit(samples)

    def greedy(sample, t):
        known, n, at = language.spelled(np.frombuffer(sample, np.uint8), np.zeros(1, np.int64))[0].tobytes(), 0, 0
        while at < len(t):
            size = 1
            while at + size < len(t) and t[at : at + size + 1] in known:
                size += 1
            at, n = at + size, n + 1
        return n

    texts = [b"abcd zyx", b"", b"bcabzzyq", b"q"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = parser.phrases(data, offsets, 0, 4)
    assert got.tolist() == [[greedy(s, t) for t in texts] for s in samples.values()]


@tables
def test_language_accuracy_and_unknown(spark, docs):
    out = QUERIES["op2_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    row = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.95 and 0 <= row[1] <= row[2] <= 1
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.fit(docs)).collect()}
    assert len(got) == docs.count() and [got[i] for i in (4, 5, 6, 11)] == ["und"] * 4 and got[7] == "en"


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = quality_model.ByteNet()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (30, 2100, 900)]
    buffer = np.frombuffer(b"".join(data), np.uint8)
    grid, text = quality_model.chunks(buffer, np.cumsum([0, *map(len, data)]))
    label = np.array([1.0, 0.0, 1.0])
    g, loss = net.gradient(grid, text, label)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        at = int(np.abs(g[name]).argmax())
        keep = flat[at]
        flat[at] = keep + 1e-6
        _, up = net.gradient(grid, text, label)
        flat[at] = keep
        assert (up - loss) / 1e-6 == pytest.approx(g[name].reshape(-1)[at], rel=2e-2, abs=1e-6)


def test_chunks_cover_whole_texts():
    for n in (0, 1, 1024, 1025, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8) | 1
        grid, text = quality_model.chunks(data, np.array([0, n]))
        hop = quality_model.CHUNK - quality_model.OVERLAP
        seen = np.zeros(n, bool)
        for k, row in enumerate(grid):
            own = data[k * hop : k * hop + quality_model.CHUNK]
            assert np.array_equal(row[: len(own)], own)
            seen[k * hop : k * hop + quality_model.CHUNK] = True
        assert seen.all() and len(text) == len(grid) >= 1


@tables
def test_quality_on_held_out_rows(spark, docs):
    out = QUERIES["op3_quality_classifier"](spark, FOLDER.replace("0.001", "0.01")).join(spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good = out.quality == 1
    assert out.predicted[good].mean() > 0.95
    assert (out.score[good].to_numpy()[:, None] > out.score[~good].to_numpy()).mean() > 0.9
    assert ((out.score >= 0) & (out.score <= 1)).all()
    net = quality_model.fit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality_model.score_quality(docs, net).where("score between 0 and 1").count() == docs.count()


def test_url_rules_by_brute_force(spark):
    urls = [None, "", "no scheme.com/", "http://com/", "http://com", "HTTP://A.Example.COM/en/x?y", "http://www.example.com/en/", "http://notexample.com/en/x", "x://net/es/", "x://a.net/fr", "x://b.net/fr/#q", "http://example.com?u=http://net/es/", "http://a.org/en/ ", "http://x.com#/en/", "http://.com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")

    def judge(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for most in (url_filter.MAX_BYTES, 1):  # by the cascade, and by the join beyond its bounds
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, max_bytes=most).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    # A host of many labels has no more suffixes than the rules have label counts; many rules go by the join.
    long = "http://" + "a." * 20000 + "example.com/en/"
    many = [(f"h{k}.org", "/", "block") for k in range(30000)] + [("example.com", "/en/", "block")]
    odd = spark.createDataFrame([(1, long), (2, "x://a.h29999.org/"), (3, "x://h30000.org/")], "page_id bigint, url string")
    for rules, most in ((url_filter.RULES, url_filter.MAX_BYTES), (many, 4096)):
        got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(odd, rules, max_bytes=most).collect()}
        assert got[1] == "example.com/en/" and got[2] == ("h29999.org/" if rules is many else None) and got[3] is None


def test_cascade_is_exact_over_its_universe(spark):
    pages = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"))
    listed = spark.range(0, 3000, 7).select(F.concat(F.lit("h"), "id", F.lit(".org /")).alias("key"))
    cascade = url_filter.build_cascade(pages, listed, [1], [2], false_rate=0.3)
    assert len(cascade.levels) > 2
    keys = spark.range(3000).select("id", F.concat(F.lit("h"), "id", F.lit(".org /")).alias("key"))
    wrong = keys.where(cascade.holds(F.col("key")) != (F.col("id") % 7 == 0)).count()
    assert wrong == 0


def test_leaks_tolerate_substitutions(spark):
    items = [(1, prose(50, 30)), (2, "Short Item, here!"), (3, None), (4, "")]
    w = items[0][1].split()
    swapped = [x if k % 5 else "other" for k, x in enumerate(w)]
    mostly = [x if k % 2 else "other" for k, x in enumerate(w)]
    texts = [prose(60, 40) + " " + " ".join(w).upper() + ".", prose(61, 20) + " " + " ".join(swapped) + " end", " ".join(mostly), prose(62, 500), None, "", "a short item here b", " ".join(w[:20]), " ".join(w[:9])]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, texts[0], "n")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (1 << 20, 0):  # broadcast and shuffle
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, broadcast_seeds=limit).collect()}
        assert got == {(0, 1), (1, 1), (6, 2), (7, 1)}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3, 4, 5, 8}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_in_repeated_words_cost_no_pairs(spark):
    """Thousands of equal words meet an item of equal words: places with the same neighbours are one place."""
    same, pair = " ".join(["junk"] * 2000), " ".join(["a b"] * 900)
    texts = [same, same, pair, "b " * 30 + prose(5, 300), " ".join(["junk"] * 20000), prose(6, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(["junk"] * 100)), (2, " ".join(["junk"] * 500)), (3, "a b " * 40), (4, "junk a b junk junk a b b")], "item_id bigint, text string")
    for limit in (1 << 20, 0):
        found = {(r["doc_id"], r["item_id"]): (r["n_equal"], r["doc_token"], r["item_token"]) for r in decontaminate.find_leaks(docs, bench, broadcast_seeds=limit).collect()}
        assert {k: v[0] for k, v in found.items()} == {(0, 1): 16, (0, 2): 16, (1, 1): 16, (1, 2): 16, (2, 3): 16, (4, 1): 16, (4, 2): 16}


def test_packing_round_trip(spark, docs, plain):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    odd = {100: "<|endoftext|> <|STARTOFTEXT|> don't DON'T it's, x\x01y a.b,c", 101: "caf\u00e9, \u201cq\u201d. \u4e2d\u6587!!", 102: "e\u0301. =\u0338 '\u0338"}
    every = {**plain, **odd}
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(odd.items()), "doc_id bigint, text string"))
    rows = packing.pack_documents(df, limit=512).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, t in every.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, a in enumerate(range(0, len(ids), 512)):
            want[i, n] = (a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()))
    assert got == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_local_search_empties_bins():
    lengths = [60, 60, 50, 50, 40, 40]
    bins = packing.improve([[0, 2 + 2], [1, 5], [2], [3]], lengths, 100)
    assert len(bins) == 3 and sorted(k for b in bins for k in b) == list(range(6))
    assert len(packing.improve([[0], [1], [2]], [6, 5, 4], 10)) == 2
    rng = np.random.default_rng(1)
    for _ in range(20):
        own = rng.integers(1, 60, 50).tolist()
        out = packing.improve([[k] for k in range(50)], own, 100)
        assert all(sum(own[k] for k in b) <= 100 for b in out) and sorted(k for b in out for k in b) == list(range(50))


def check_shards(rows, texts: list[tuple]):
    """Every row once, sizes and slots right; returns bytes by shard and shards by text."""
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    crc = {zlib.crc32((t or "").encode()): t or "" for _, t in texts}
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[crc[r["text_crc32"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, where


def test_sharding(spark, docs, plain):
    copies = spark.range(400).select((F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") < 150, F.lit("hot copy " * 5)).otherwise(F.concat(F.lit("text "), (F.col("id") % 90).cast("string"))).alias("text"))
    every = docs.select("doc_id", "text").where("doc_id <> 17").union(copies)
    texts = [(r["doc_id"], r["text"]) for r in every.collect()]
    size, where = check_shards(sharding.shard_documents(every).collect(), texts)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(len((t or "").encode()) + 1 for _, t in texts)
    # Only groups that are larger than a shard are in several.
    held = Counter()
    for _, t in texts:
        held[t or ""] += len((t or "").encode()) + 1
    assert "hot copy " * 5 in {t for t, s in where.items() if len(s) > 1} <= {t for t, n in held.items() if 8 * n > held.total()}
    assert sharding.shard_documents(every.limit(0)).count() == 0


def test_sharding_of_repeated_rows_and_large_groups(spark):
    """Rows that share a doc_id have a slot each; groups of over half a shard stay whole where there is room."""
    texts = [(1, "a"), (1, "a"), (1, "b b"), (2, "c"), (3, "a"), (3, None)]
    check_shards(sharding.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect(), texts)
    texts = [(i, f"group {i % 6:02d} of texts") for i in range(300)] + [(1000 + i, prose(i, 8)) for i in range(100)]
    size, where = check_shards(sharding.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect(), texts)
    assert all(len(s) == 1 for s in where.values()) and max(size.values()) - min(size.values()) <= 200
    texts = [(i, f"group {i % 12:02d} of texts") for i in range(600)]
    size, where = check_shards(sharding.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string")).collect(), texts)
    assert sum(len(s) == 1 for s in where.values()) >= 8 and max(size.values()) - min(size.values()) <= 40


def test_quality_counts_by_brute_force(docs, plain):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in plain.items():
        raw = (t or "").encode()
        w = raw.split()
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        full = [x for x in raw.split(b"\n") if x.strip(SPACE)]
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


@tables
def test_quality_rules_keep_clean_documents(spark):
    folder = FOLDER.replace("0.001", "0.01")
    out = QUERIES["op8_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    row = out.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("double"))), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("double")))).first()
    assert row[0] > 0.99 and (row[1] is None or row[1] < row[0])


def brute_lines(plain, least=20, most=3):
    holders = defaultdict(set)
    key = lambda x: x.encode().strip(SPACE).lower()
    for i, t in plain.items():
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= least:
                holders[key(x)].add(i)
    out = {}
    for i, t in plain.items():
        rows = (t or "").split("\n")
        kept = [x for x in rows if not (len(holders[key(x)]) >= most and max(holders[key(x)]) != i)]
        out[i] = (len(rows), len(rows) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def lines_of(out):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()}


def test_line_dedup_and_its_reversal(docs, plain):
    """After each insertion and deletion counts, filters and results are those of an index built anew."""
    assert lines_of(line_dedup.dedup_lines(docs.withColumn("_lost", F.lit(1)))) == brute_lines(plain)
    part = lambda *ids: docs.where(F.col("doc_id").isin(*ids)).select("doc_id", "text")
    index, here = line_dedup.LineIndex.of(docs.select("doc_id", "text")), set(plain)
    shared = [i for i, t in plain.items() if "many of these documents share" in (t or "")]
    steps = [("delete", shared[2:]), ("insert", shared[2:4]), ("delete", shared[:1]), ("insert", [*shared, 3]), ("delete", list(plain))]
    for how, ids in steps:
        index = getattr(index, how)(part(*ids))
        here = here - set(ids) if how == "delete" else here | set(ids)
        rest = docs.where(F.col("doc_id").isin(*here)) if here else docs.limit(0)
        fresh = line_dedup.LineIndex.of(rest.select("doc_id", "text"))
        for table in ("postings", "counts"):
            assert sorted(getattr(index, table).collect()) == sorted(getattr(fresh, table).collect())
        held = [line_dedup.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()]
        keys = np.array([r["k1"] for r in index.repeated().collect()], np.int64).view(np.uint64)
        assert sum(np.count_nonzero(f.table) + len(f.stash) for f in held) == len(keys)
        assert not len(keys) or held[0].holds(keys).all()
        assert lines_of(line_dedup.dedup_lines(rest, index)) == brute_lines({i: plain[i] for i in here})
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_index_grows(spark, monkeypatch):
    """Filters too small for their keys are built larger, and shards multiply with the keys."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 40)
    rows = lambda a, b: spark.createDataFrame([(3 * k + c, f"line number {k} of the whole table") for k in range(a, b) for c in range(3)], "doc_id bigint, text string")
    index = line_dedup.LineIndex.of(rows(0, 30))
    for a, b, shards in ((30, 75, 1), (75, 200, 5)):
        index = index.insert(rows(a, b))
        keys = np.array([r["k1"] for r in index.repeated().collect()], np.int64)
        held = {r["shard"]: line_dedup.CuckooFilter.from_bytes(r["filter"]) for r in index.filters.collect()}
        assert len(keys) == b and index.shards == shards == len(held)
        assert all(held[int(k % shards)].holds(np.array([k], np.int64).view(np.uint64)).all() for k in keys)
        assert index.dropped().count() == 2 * b


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2)
    f = line_dedup.CuckooFilter(len(keys))
    f.add(keys)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    others = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert f.holds(keys).all() and f.holds(others).mean() < 0.01
    f.discard(keys[:5000])
    assert f.holds(keys[5000:]).all() and f.holds(keys[:5000]).mean() < 0.01
    full = line_dedup.CuckooFilter(10)
    full.add(keys[:200])
    assert full.stash and full.holds(keys[:200]).all()


def test_language_model_by_brute_force(docs, plain):
    train = {i: t for i, t in plain.items() if i % 4}
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs, docs.where("doc_id % 4 <> 0"), limit=20).collect()}
    c = Counter()
    for t in train.values():
        c.update(words(t))
        c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    for i, t in plain.items():
        w = [*words(t), b"\n"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] < 0
    assert lm_score.score_texts(docs.limit(0), docs).count() == 0
    nothing = lm_score.score_texts(docs, docs.limit(0)).collect()
    assert len(nothing) == len(plain) and all(r["n_known"] == 0 for r in nothing)


def test_suffix_tree_states_follow_the_longest_context():
    """The table's score equals that of looking up the longest kept context at every byte."""
    rng = np.random.default_rng(4)
    train = b"".join(bytes(rng.choice(list(b"abc"), 6)) + b" " for _ in range(300)) + b"\n"
    contexts = {(0, 0), (1, 97), (1, 98), (2, (97 << 8) | 98), (3, (99 << 16) | (97 << 8) | 98)}
    rows = []
    for d, ctx in contexts:
        own = ctx.to_bytes(d, "big")
        seen = Counter(train[k] for k in range(d, len(train)) if train[k - d : k] == own)
        rows += [(d, ctx, b, n) for b, n in seen.items()]
    tree = lm_score.SuffixTree.build(rows)
    counts = defaultdict(dict)
    for d, ctx, b, n in rows:
        counts[d, ctx][b] = n

    def prob(d, ctx, b):
        if not d:
            return (counts[0, 0].get(b, 0) + 0.5) / (sum(counts[0, 0].values()) + 128)
        own = counts[d, ctx]
        up = next((e, ctx & ((1 << 8 * e) - 1)) for e in range(d - 1, -1, -1) if (e, ctx & ((1 << 8 * e) - 1)) in contexts)
        return (own.get(b, 0) + lm_score.SMOOTHING * prob(*up, b)) / (sum(own.values()) + lm_score.SMOOTHING)

    texts = [bytes(rng.choice(list(b"abcz "), n)) + b"\n" for n in (0, 5, 1300)]
    stream, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = []
    for t in texts:
        full, total = b"\n" * 5 + t, 0.0
        for k in range(5, len(full)):
            d, ctx = max((d, c) for d, c in contexts if full[k - d : k] == c.to_bytes(d, "big"))
            total += math.log10(prob(d, ctx, full[k]))
        want.append(total)
    np.testing.assert_allclose(tree.score(stream, edges), want, rtol=1e-4)
    # Every context's distribution over all bytes sums to 1.
    assert sum(prob(2, (97 << 8) | 98, b) for b in range(256)) == pytest.approx(1)


def test_long_texts_score_as_one_block_or_many():
    data = prose(3, 3000).encode() + b"\n"
    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1)
    stream, edges = lm_score.byte_streams(w)
    assert stream.tobytes() == b" ".join(data.split()) + b"\n" and edges.tolist() == [0, len(stream)]
    got = lm_score._runs(stream, edges, 5)
    assert got[0] == int.from_bytes(b"\n" * 5 + stream[:1].tobytes(), "big") and got[9] == int.from_bytes(stream[4:10].tobytes(), "big")


@pytest.mark.parametrize("limit", [1 << 20, 1000])
def test_tree_keeps_every_context_that_passes(spark, limit):
    """Over 12,000 contexts pass: the scores are those of all of them, for runs that tasks hold and for runs that are joined."""
    rng = np.random.default_rng(8)
    known = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 6)) for _ in range(4000)]
    train = [" ".join(known[k] for k in rng.permutation(4000)) for _ in range(12)]
    texts = [*train[:1], " ".join(known[k][::-1] for k in range(40)), known[3] + " " + known[7] + " \u00e9", None, ""]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    counts = [defaultdict(Counter) for _ in range(6)]
    for t in train:
        full = b"\n" * 5 + t.encode() + b"\n"
        for k in range(5, len(full)):
            for d in range(6):
                counts[d][full[k - d : k]][full[k]] += 1
    kept = set()
    for d in range(1, 6):
        for ctx, own in counts[d].items():
            up = counts[d - 1][ctx[1:]]
            n, m = own.total(), up.total()
            if sum(c * (math.log(c / n) - math.log(up[b] / m)) for b, c in own.items()) - len(own) > lm_score.DIVERGENCE:
                kept |= {ctx[k:] for k in range(d)}
    assert len(kept) > 12_000

    def prob(full, k):
        p = (counts[0][b""][full[k]] + 0.5) / (counts[0][b""].total() + 128)
        for d in range(1, 6):
            ctx = full[k - d : k]
            if ctx not in kept:
                break
            p = (counts[d][ctx][full[k]] + lm_score.SMOOTHING * p) / (counts[d][ctx].total() + lm_score.SMOOTHING)
        return p

    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(frame(texts), frame(train), limit=limit).collect()}
    for i, t in enumerate(texts):
        full = b"\n" * 5 + (t or "").encode() + b"\n"
        assert got[i] == pytest.approx(sum(math.log10(prob(full, k)) for k in range(5, len(full))), rel=1e-9)


def test_masks_meet_every_pattern_that_the_rule_takes():
    for n in range(1, decontaminate.WINDOW + 1):
        for wrong in itertools.combinations(range(n), n - -(-decontaminate.PERCENT * n // 100)):
            equal = "".join("0" if k in wrong else "1" for k in range(n))
            assert any(all(equal[at + k] == "1" for k, c in enumerate(m) if c == "1") for m in decontaminate.masks_of(n) for at in range(n - len(m) + 1)), equal


def test_leaks_with_substitutions_equal_the_sql(spark, tmp_path):
    """Every 4th word replaced in each phase, single windows with up to 4 changed words, and short items with one to three."""
    rng = np.random.default_rng(5)
    fresh = itertools.count()
    change = lambda w, at: " ".join(f"z{next(fresh)}" if k in at else x for k, x in enumerate(w))
    bench, docs = [], []
    for item, n in enumerate([*range(1, 17), 24, 40]):
        w = [f"i{item}w{k}" for k in range(n)]
        bench.append((item, " ".join(w)))
        docs += [f"a b {change(w, set(range(phase, n, 4)))} c" for phase in range(4)]
        wrong = [c for k in range(5) for c in itertools.combinations(range(min(n, 16)), k)]
        docs += [change(w[:16], set(wrong[k])) for k in rng.permutation(len(wrong))[:60]]
    spark.createDataFrame(bench, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    name = "op5_decontamination"
    assert assert_same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], views(str(tmp_path))) > 300


def test_language_without_labels_and_with_many_languages(spark, docs, tmp_path):
    from corpus_pipeline import identify_language

    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    for k, rows in enumerate((docs.limit(0), unlabelled)):
        rows.write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        got = QUERIES["op2_language_id"](spark, str(tmp_path / str(k))).collect()
        assert len(got) == rows.count() and all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got)
        assert identify_language(spark, rows, "").count() == 0
    # 66 languages, each of its own letters.
    spoken = {f"l{k:02d}": " ".join(chr(0x4E00 + 40 * k + (7 * m + m * m) % 31) * 2 for m in range(60)) for k in range(66)}
    many = spark.createDataFrame([(k, t, n) for k, (n, t) in enumerate(spoken.items())], "doc_id bigint, text string, lang string")
    samples = language.fit(many)
    got = {part: {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.predict(many, samples, part).collect()} for part in (64, 7, 100)}
    assert got[64] == got[7] == got[100] and [got[64][k][0] for k in range(66)] == list(spoken)


def test_quality_sample_skips_a_long_text_and_falls_back_to_the_base_rate(spark, monkeypatch):
    rows = [(k, prose(k, 20), k % 2) for k in range(40)]
    first = spark.createDataFrame(rows, "doc_id bigint, text string, quality int").where("quality = 1").orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    docs = spark.createDataFrame([(k, t * 500 if k == first else t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality_model.ByteNet, "train", lambda self, data, y, epochs: seen.append(Counter(y.tolist())))
    quality_model.fit(docs, labels, max_bytes=20_000)
    assert seen == [Counter({0.0: 20, 1.0: 19})]
    for marked, base in ((labels.where("quality = 1"), 21 / 22), (labels.limit(0), 0.5)):
        scores = [r["score"] for r in quality_model.score_quality(docs, quality_model.fit(docs, marked)).collect()]
        assert len(scores) == 40 and scores == pytest.approx([base] * 40)


def test_parse_of_a_text_longer_than_a_block():
    """Greedy phrases, begun anew after each BLOCK symbols for all languages alike."""
    rng = np.random.default_rng(11)
    samples = {"p": prose(1, 300).encode(), "q": prose(2, 300)[::-1].encode()}
    parser = language.CrossParser.fit(samples)
    text = bytes(rng.choice(list(b"abcdehinorstw 12"), 700)) + prose(1, 200).encode()
    data = language.spelled(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))[0].tobytes()

    def greedy(sample):
        known, n = language.spelled(np.frombuffer(sample, np.uint8), np.zeros(1, np.int64))[0].tobytes(), 0
        for a in range(0, len(data), language.BLOCK):
            t, at = data[a : a + language.BLOCK], 0
            while at < len(t):
                size = 1
                while at + size < len(t) and t[at : at + size + 1] in known:
                    size += 1
                at, n = at + size, n + 1
        return n

    got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, 1)
    assert got[:, 0].tolist() == [greedy(s) for _, s in sorted(samples.items())] and len(data) > 2 * language.BLOCK


def test_language_sample_takes_whole_texts(spark):
    texts = {k: prose(k, 20 + 15 * k) for k in range(20)}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()] + [(99, prose(99, 3000), "x"), (100, "only a long one " * 400, "y")], "doc_id bigint, text string, lang string")
    got = language.fit(docs, train_bytes=3000)
    assert set(got) == {"x", "y"} and all(len(v) <= 3000 for v in got.values())
    lines, long = got["x"].decode().strip("\n").split("\n"), prose(99, 3000)
    assert len(lines) > 2 and all(t in texts.values() or (len(t) <= 375 and t in long) for t in lines)
    # A language with long texts only is learned from pieces of them; equal rows add nothing to the sample.
    assert len(got["y"]) > 1000 and all(t in "only a long one " * 400 for t in got["y"].decode().strip("\n").split("\n"))
    assert language.fit(docs.union(docs), train_bytes=3000) == got


def test_best_step_equals_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(40):
        n, limit = rng.integers(1, 30, 14), 60
        place = rng.integers(0, 5, 14)
        fill = np.bincount(place, n, 5).astype(np.int64)
        if (fill > limit).any() or not fill[0]:
            continue
        rise = 0
        own = np.flatnonzero(place == 0).tolist()
        gives = [(k,) for k in own] + list(itertools.combinations(own, 2))
        for give in gives:
            for other in [b for b in range(1, 5) if 0 < fill[b] < limit]:
                for take in [(), *[(k,) for k in np.flatnonzero(place == other)]]:
                    gain = int(n[list(give)].sum() - n[list(take)].sum())
                    if 0 < gain <= limit - fill[other]:
                        rise = max(rise, gain * int(fill[other] - fill[0] + gain))
        step = packing._best_step(0, place, n, fill, limit)
        assert (step is None) == (rise == 0)
        if step:
            gain = int(n[step[0]].sum() - n[step[1]].sum())
            assert gain * int(fill[step[2]] - fill[0] + gain) == rise and gain <= limit - fill[step[2]]


def test_scores_of_rows_that_share_an_id(spark):
    """Each row by its own text, also where words and runs are joined."""
    texts = [prose(1, 80), prose(2, 60), prose(1, 80), None]
    rows = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string")
    alone = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    train = alone.where("doc_id < 2")
    shape = lambda df: sorted(tuple(r[c] for c in ("n_tokens", "n_known", "train_tokens")) + (round(r["base_score"], 9), round(r["score"], 9)) for r in df.collect())
    for limit in (1 << 20, 5):
        assert shape(lm_score.score_texts(rows, train, limit=limit)) == shape(lm_score.score_texts(alone, train, limit=limit))


def test_fences_on_both_sides(spark):
    """Words far longer or shorter than the group's, and a text full of symbols, are outside; a group of one takes the corpus's fences."""
    texts = [prose(k, 80) for k in range(60)] + [" ".join("extraordinarily" + w for w in prose(70, 80).split()), " ".join(w[0] + str(k % 10) for k, w in enumerate(prose(71, 80).split())), " # ".join(prose(72, 80).split())]
    rows = [(k, t, "en", "one" if k == 5 else "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert {k for k, (failed, kept) in got.items() if not failed and not kept} == {60, 62} | ({61} if not got[61][0] else set())


def test_kernels_on_texts_longer_than_a_stretch(monkeypatch):
    """Hashes and blocks do not depend on how a long text is cut for the work."""
    from sparkchemo.llm import lockstep, textkit

    texts = [b"", prose(1, 300).encode(), b"x", b"a" * 500 + b" b", b" \n"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = Words(data, offsets, 0, len(texts)).hashes()
    monkeypatch.setattr(textkit, "STRETCH", 64)
    assert np.array_equal(Words(data, offsets, 0, len(texts)).hashes(), want)
    for lead in (0, 3, 40):
        grid, text = lockstep.blocks(data, offsets, 32, lead, 255)
        assert np.bincount(text, minlength=5).tolist() == [-(-len(t) // 32) for t in texts]
        first = np.searchsorted(text, text)
        for k in range(len(text)):
            own, at = texts[text[k]], (k - first[k]) * 32
            row = [own[i] if 0 <= i < len(own) else 255 for i in range(at - lead, at + 32)]
            assert grid[:, k].tolist() == row

