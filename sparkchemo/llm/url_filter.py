"""URL filter: exact membership of host and path rules by a cascade of Bloom filters.

A rule fits its host and all subdomains when the url's path starts with the rule's
path, so a url asks about a few keys: each suffix of its host with each prefix of its
path that is as long as some rule's path. Level 0 encodes the rules, level 1 the corpus
keys that level 0 takes by mistake, level 2 the rules that level 1 takes, and so on
until a level makes no mistake over the corpus's whole key universe. A key's membership
then follows from the first level that refuses it, with no join in the judging pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import ascii_lower, stored

#: host, path, verdict
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bytes of a filter and levels of a cascade at most; beyond them keys are looked up by a join.
MAX_BYTES, MAX_LEVELS = 1 << 20, 32


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.substring_index(F.translate(rest, "?#", "//"), "/", 1))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3 + F.length(host_of(url)), F.length(url))
    return F.when(at > 0, F.substring_index(F.translate(rest, "?", "#"), "#", 1)).otherwise("")


def candidate_keys(host: Column, path: Column, path_lengths: list[int], labels: list[int]) -> Column:
    """Every (host suffix + path prefix) that a rule could have, longest first.

    ``path_lengths`` are the distinct lengths of the listed paths, ``labels`` the distinct numbers of labels of the listed hosts, so a
    host has as many suffixes however many labels it has itself. A key is the text
    ``suffix`` + space + ``prefix``; a space occurs in neither a listed host nor path.
    """
    own = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array(*[F.when(own >= n, F.substring_index(host, ".", -n)) for n in sorted(labels, reverse=True)])
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(path_lengths, reverse=True)])
    some = lambda a: F.filter(a.cast("array<string>"), lambda x: x.isNotNull())
    return F.flatten(F.transform(some(suffixes), lambda s: F.transform(some(prefixes), lambda p: F.concat(s, F.lit(" "), p))))


def _slots(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + k)), F.lit(bits)) for k in range(hashes)]


@dataclass(frozen=True)
class BloomLevel:
    """One filter of the cascade: ``words`` holds its bits as 64-bit numbers."""

    level: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def takes(self, key: Column) -> Column:
        # One text literal that Catalyst folds to an array once per plan.
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = []
        for slot in _slots(key, self.level, self.bits, self.hashes):
            word = F.get(table, F.floor(slot / 64).cast("int"))
            hit.append(F.getbit(word, (slot % 64).cast("int")) == 1)
        out = hit[0]
        for h in hit[1:]:
            out = out & h
        return out


def build_level(keys: DataFrame, level: int, n: int, false_rate: float, max_bytes: int) -> BloomLevel | None:
    """A Bloom filter of the ``n`` keys (column ``key``), gathered as set bits per 64-bit word.

    What reaches the driver is the filter itself: at most ``max_bytes``, checked before the
    job starts. None if it would be larger.
    """
    bits = max(64, 64 * math.ceil(-n * math.log(false_rate) / math.log(2) ** 2 / 64))
    if bits // 8 > max_bytes:
        return None
    hashes = max(1, round(bits / max(n, 1) * math.log(2)))
    hashes = min(hashes, 16)
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, bits, hashes))).alias("slot"))
    got = slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("value")).collect()
    table = [0] * (bits // 64)
    for row in got:
        table[row["word"]] = row["value"]
    return BloomLevel(level, bits, hashes, tuple(table))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[BloomLevel, ...]
    path_lengths: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        """Exact membership of a key of the universe the cascade was built over."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)  # every level takes it: the last one decides
        for level in reversed(self.levels):
            out = F.when(~level.takes(key), F.lit(level.level % 2 == 1)).otherwise(out)
        return out


def build_cascade(pages: DataFrame, listed: DataFrame, path_lengths: list[int], labels: list[int], false_rate: float = 0.01, max_bytes: int = MAX_BYTES, max_levels: int = MAX_LEVELS) -> Cascade | None:
    """The cascade over ``listed`` (column ``key``) and all candidate keys of ``pages`` (columns host, path); None beyond its bounds.

    Level 0 filters the exploded keys before anything is shuffled, so only mistaken keys
    (about ``false_rate`` of the universe) are made distinct; deeper levels work on those.
    """
    listed = listed.select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade((), tuple(path_lengths))
    universe = pages.select(F.explode(candidate_keys(F.col("host"), F.col("path"), path_lengths, labels)).alias("key"))
    levels = [build_level(listed, 0, n, false_rate, max_bytes)]
    if levels[0] is None:
        return None
    mistaken = universe.where(levels[0].takes(F.col("key"))).distinct().join(listed, "key", "left_anti")
    others = listed
    while (n := mistaken.count()) > 0:
        level = build_level(mistaken, len(levels), n, 0.5, max_bytes)
        if level is None or len(levels) >= max_levels:
            return None
        levels.append(level)
        # The keys of the other side that this level takes by mistake come next.
        mistaken, others = others.where(level.takes(F.col("key"))), mistaken
    return Cascade(tuple(levels), tuple(path_lengths))


def hits_by_join(parts: DataFrame, rules: list[tuple[str, str, str]], keys: Column) -> DataFrame:
    """``parts`` with ``best``, the longest fitting rule, for rules too many for a cascade."""
    rows = stored(parts.withColumn("row", F.monotonically_increasing_id()), "url-rows")
    listed = parts.sparkSession.createDataFrame([(f"{h} {p}", v) for h, p, v in rules], "key string, verdict string")
    hits = rows.select("row", F.explode(keys).alias("key")).join(listed, "key")
    best = hits.groupBy("row").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("best"))
    return rows.join(best, "row", "left")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Judge every url of ``pages`` (page_id, url); other columns are left alone and not returned.

    Returns page_id, host, path, rule (host + path of the longest fitting rule, else null),
    verdict (the rule's; ``default`` for a url that the cascade finds under no listed key).

    A null url, or one without ``://``, has an empty host and path and so fits no rule.
    Repeated rows are judged each; an empty table gives an empty result. Two rules with the
    same host and path are an error. Rules that need a filter above ``max_bytes``, or too many
    levels, are looked up by a join, with the same result. A page that has columns called host, path or rule
    keeps them out of the way: only page_id and url are read.
    """
    spark = pages.sparkSession
    if len({r[:2] for r in rules}) < len(rules):
        raise ValueError("a host and path are listed twice")
    lengths, labels = sorted({len(path) for _, path, _ in rules}), sorted({host.count(".") + 1 for host, *_ in rules})
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # One text literal for a list of rules, however long.
    listed = {v: spark.range(1).select(F.explode(F.split(F.lit("\n".join(f"{h} {p}" for h, p, w in rules if w == v)), "\n")).alias("key")).where("key <> ''") for v in ("allow", "block")}
    cascades = {v: build_cascade(parts, listed[v], lengths, labels, max_bytes=max_bytes) for v in ("allow", "block")}
    keys = candidate_keys(F.col("host"), F.col("path"), lengths, labels)
    if None in cascades.values():
        judged = hits_by_join(parts, rules, keys)
    else:
        # Longest first: a longer host suffix, then a longer path.
        hits = F.filter(
            F.transform(keys, lambda k: F.struct(k.alias("key"), F.when(cascades["block"].holds(k), "block").when(cascades["allow"].holds(k), "allow").alias("verdict"))),
            lambda x: x["verdict"].isNotNull(),
        )
        # Of all rules that fit, the longest text (suffix and prefix lengths both count).
        judged = parts.withColumn("best", F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["key"]).alias("n"), x["key"].alias("key"), x["verdict"].alias("verdict")))))
    return judged.select(
        "page_id", "host", "path",
        F.replace(F.col("best.key"), F.lit(" "), F.lit("")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


ORACLE = {
    "op4_url_filter": r"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
  FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = rhost OR p.host LIKE '%.' || rhost) AND starts_with(p.path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
}
