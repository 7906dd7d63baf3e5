"""Benchmark decontamination by spaced-seed hashing.

A seed is a hash of a window of tokens without the positions that its mask ignores, so a
substituted word at an ignored position changes nothing. Seeds of documents meet seeds of
benchmark items in a join; around each hit the aligned tokens are compared one by one,
and a window in which enough of them are equal is a leak.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import LOWER, SPACES, UPPER, stored

#: Token positions that count (1) and those that are ignored (0). Found by enumeration: however the equal tokens that
#: the rule asks for lie in a window of 16, at least one mask fits on equal tokens alone.
MASKS = ("111011", "1100001011", "111100001", "111000101")
#: The same for items of fewer tokens, which are one window.
SHORT_MASKS = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("111", "1101", "1011"), 5: ("1111", "10111", "11101", "11011"), 6: ("11011", "101101"), 7: ("11011",),
    8: ("11011", "1100011", "101101"), 9: ("11011", "11000101"), 10: ("111011", "11000111", "110100011"), 11: ("1101011", "111000101"),
    12: ("111011", "110100011", "11001011", "110111"), 13: ("110111", "101001011", "110100011"), 14: ("111011", "11111", "11100101"), 15: ("111011", "1101101"),
}
#: From so many tokens on an item has MASKS.
LONG = max(SHORT_MASKS) + 1
#: A leak: in some window of WINDOW aligned tokens (or all of a shorter item) this percentage is equal.
WINDOW, PERCENT = 16, 75
#: Benchmark seeds that are broadcast at most (each about 40 bytes), and seeds with their neighbourhoods (about 400 bytes).
BROADCAST_SEEDS, BROADCAST_PLACES = 1_000_000, 100_000


def token_hashes(text: Column) -> Column:
    """Hashes of the words, A-Z lower-cased and without ASCII punctuation; a word of nothing else is dropped."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + string.punctuation, LOWER)
    inner = F.btrim(plain, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def masks_of(length: int) -> tuple[str, ...]:
    """The masks for items of ``length`` tokens."""
    return SHORT_MASKS.get(length, MASKS)


def _seed(tokens: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(int(mask, 2)), *[F.get(tokens, at + k) for k, c in enumerate(mask) if c == "1"])


def tokenised(rows: DataFrame, key: str) -> DataFrame:
    """(key, tokens) of the texts with a token; the generator keeps filters from computing the tokens again."""
    return rows.select(key, F.explode(F.array(token_hashes(F.col("text")))).alias("tokens")).where(F.size("tokens") > 0)


def seeds(rows: DataFrame, lengths: list[int], own: bool = False) -> DataFrame:
    """A row per place and mask: ``rows`` (with ``tokens``) with ``at`` and ``seed``.

    The masks are those for items of ``lengths`` (at most LONG); with ``own``, each row's are those for its own length.
    The explode, the hashes and a broadcast join behind them stay in one generated loop.
    """
    placed = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)))
    tokens, at = F.col("tokens"), F.col("at")
    found = []
    for mask in sorted({m for n in lengths for m in masks_of(n)}):
        fits = at + len(mask) <= F.size("tokens")
        if own:
            fits = fits & F.least(F.size("tokens"), F.lit(LONG)).isin([n for n in lengths if mask in masks_of(n)])
        found.append(F.when(fits, _seed(tokens, at, mask)))
    return placed.withColumn("seed", F.explode(F.array(*found))).where(F.col("seed").isNotNull())


def neighbourhood(tokens: Column, at: Column, window: int) -> Column:
    """(left, near): the tokens less than ``window`` places from ``at``, and how many of them stand before it."""
    left = F.least(at, F.lit(window))
    return F.struct(left.alias("left"), F.slice(tokens, at - left + 1, left + window).alias("near"))


def overlap(doc: Column, item: Column, size: Column, window: int) -> Column:
    """Around a hit the most equal tokens in a window of ``size``; ``doc`` and ``item`` are neighbourhoods of its two places.

    One walk along the alignment: each step counts the token that enters the window and takes off the one that leaves.
    """
    left = F.least(doc["left"], item["left"])
    right = F.least(F.size(doc["near"]) - doc["left"], F.size(item["near"]) - item["left"], F.lit(window))
    equal = lambda k: F.when(F.get(doc["near"], doc["left"] + k) == F.get(item["near"], item["left"] + k), 1).otherwise(0)

    def step(seen: Column, k: Column) -> Column:
        gone = F.when(k - size >= -left, equal(k - size)).otherwise(0)
        # [equal tokens in the window that ends here, the most so far]
        return F.array(seen[0] + equal(k) - gone, F.greatest(seen[1], seen[0] + equal(k) - gone))

    return F.aggregate(F.sequence(-left, right - 1), F.array(F.lit(0), F.lit(0)), step)[1]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_equal, doc_token, item_token): documents that hold a passage of a benchmark item.

    A row per pair: the most equal tokens in a window of ``window`` aligned tokens, and a
    place (in tokens) of a seed in it, the first of the best. ``docs`` has doc_id and
    text, ``benchmark`` item_id and text; other columns are not read.

    What a hit finds depends on the neighbourhoods of its two places alone, so places of a text
    with the same one are one place, however often its words repeat, and neither whole texts
    nor pairs of repeated places are ever formed. Seeds of up to ``broadcast_seeds`` benchmark places are
    broadcast, and documents are then read in one pass without a shuffle; beyond that, seeds meet
    in a shuffle join and only documents with a hit are read again. Null and empty texts hold nothing
    and leak nothing. Every pair that meets the rule has a hit at the default ``window`` and ``percent`` or a
    higher ``percent``. Repeated rows change nothing. Empty tables give an empty result.
    """
    items = tokenised(benchmark, "item_id").distinct()
    lengths = sorted(r["n"] for r in items.select(F.least(F.size("tokens"), F.lit(LONG)).alias("n")).distinct().collect()) or [LONG]
    near = neighbourhood(F.col("tokens"), F.col("at"), window)
    own = seeds(items, lengths, own=True).select("item_id", F.least(F.lit(window), F.size("tokens")).alias("size"), "seed", near.alias("item"), "at")
    own = stored(own.groupBy("item_id", "size", "seed", "item").agg(F.min("at").alias("pos")), "leak-seeds")
    keys = own.select("seed").distinct()
    n_seeds = own.count()
    texts = tokenised(docs, "doc_id")
    if n_seeds <= broadcast_seeds:
        places = seeds(texts, lengths).join(F.broadcast(keys), "seed")
    else:
        places = seeds(texts, lengths).select("doc_id", "at", "seed").join(keys, "seed").distinct().join(texts, "doc_id")
    places = places.select("doc_id", "seed", near.alias("doc"), "at").groupBy("doc_id", "seed", "doc").agg(F.min("at").alias("at"))
    hits = places.join(F.broadcast(own) if n_seeds <= min(broadcast_seeds, BROADCAST_PLACES) else own, "seed")
    n_equal = overlap(F.col("doc"), F.col("item"), F.col("size"), window)
    found = hits.select("doc_id", "item_id", n_equal.alias("n_equal"), "at", "pos", "size")
    # Too few equal tokens are told apart only after the grouping, so each overlap is computed once.
    best = F.max(F.struct("n_equal", (-F.col("at")).alias("at"), (-F.col("pos")).alias("pos"), "size"))
    leaks = found.groupBy("doc_id", "item_id").agg(best.alias("b")).where(100 * F.col("b.n_equal") >= percent * F.col("b.size"))
    return leaks.select("doc_id", "item_id", F.col("b.n_equal").alias("n_equal"), (-F.col("b.at")).alias("doc_token"), (-F.col("b.pos")).alias("item_token"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which ``find_leaks`` finds a leak; a null doc_id is never one."""
    return docs.join(find_leaks(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row per document and benchmark item of which it holds a passage, with the most equal tokens of a window."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "n_equal")


ORACLE = {
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark
), dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
bt AS (SELECT item_id, unnest(w) AS t, generate_subscripts(w, 1) AS k, least(16, len(w)) AS size FROM b),
e AS (SELECT doc_id, item_id, i - k AS diag, k, size FROM dt JOIN bt USING (t)),
s AS (
  SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY k RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n_equal FROM e
)
SELECT doc_id, item_id, max(n_equal) AS n_equal FROM s WHERE 100 * n_equal >= 75 * size GROUP BY doc_id, item_id
"""
}
