"""Quality rules: fixed base rules, then fences from tail quantiles of sketches per language and source.

The counts of a text come from array expressions over its words, so nothing is exploded.
The fences come from ``approx_percentile`` (a mergeable quantile summary: each task sketches
its rows of a group, and only sketches are shuffled), then join back to the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import SPACES, stored, words

SYMBOLS = "#*$%&|<>"
#: metric: (reach, least tail). The upper fence is the 0.9 quantile plus ``reach`` times the tail, its distance from the
#: median; a tail below the least one, as in a group where nearly all texts have 0, counts as that.
METRICS = {"mean_word_chars": (3.0, 0.1), "symbols_a_word": (16.0, 0.015), "dup_line_share": (16.0, 0.03), "repeat_share": (16.0, 0.015)}
#: Metrics with a lower fence too: the 0.1 quantile less ``reach`` times its distance from the median.
BOTH_SIDES = ("mean_word_chars",)
QUANTILES, ACCURACY = [0.1, 0.5, 0.9], 10_000
#: Texts that the corpus's quantiles count for beside a group's own.
SHRINK = 100.0


def repeated_words(w: Column) -> Column:
    """Words of ``w`` (array) inside a 3-word window whose words occur as a window twice or more.

    Windows become 64-bit hashes. If all are distinct the answer is 0; else the windows are
    sorted by hash, those next to an equal one are repeated, and the windows' union is
    counted from their sorted positions: each adds at most 3 words, fewer if it overlaps.
    """
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

        at = bind(pairs, positions)
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    repeated = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)))
    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(repeated)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def count_text(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    line_counts = bind(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup")))
    return base.select(
        "doc_id", "lang", "source",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.translate(F.col("text"), SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate(F.col("text"), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        line_counts.alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), F.col("lines.n").alias("n_lines"), "n_repeat_words")


def metrics(counts: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and the metrics that fences are about."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "mean_word_chars": F.col("word_chars") / n,
            "symbols_a_word": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
        }
    )


def fences(measured: DataFrame) -> DataFrame:
    """g_lang, g_source and each metric's fence: low_<metric> where it has one, high_<metric>, and tail_<metric>.

    From mergeable sketches of the texts that pass the base rules. A group's quantiles are
    shrunk towards the corpus's, by SHRINK texts, so that a few texts set no fence alone.
    """
    passed = measured.where(~F.col("base_failed"))
    sketch = lambda name: [F.percentile_approx(m, QUANTILES, ACCURACY).alias(f"{name}_{m}") for m in METRICS]
    corpus = passed.agg(*sketch("c")).first()  # a row of three numbers a metric
    groups = passed.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.count(F.lit(1)).cast("double").alias("g_n"), *sketch("g"))
    out = ["g_lang", "g_source"]
    for m, (reach, least) in METRICS.items():
        low, mid, high = ((F.col("g_n") * F.col(f"g_{m}")[k] + SHRINK * F.lit(corpus[f"c_{m}"][k] if corpus[f"c_{m}"] else 0.0)) / (F.col("g_n") + SHRINK) for k in range(3))
        out += [(high - mid).alias(f"tail_{m}"), (high + reach * F.greatest(high - mid, F.lit(least))).alias(f"high_{m}")]
        if m in BOTH_SIDES:
            out.append((low - reach * F.greatest(mid - low, F.lit(least))).alias(f"low_{m}"))
    return groups.select(out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs`` (doc_id, text, lang, source).

    ``base_failed``: under 50 words, or over half of them in repeated windows. ``kept`` is
    false for those, and for a text with a metric beyond its group's fence (see METRICS).
    Groups are (lang, source) over the texts that pass the base rules; a null lang or source
    is a value of its own. At least nine tenths of the corpus lie within every fence.

    Null texts count as empty and fail the base rules. Repeated rows count each. Ties with a
    fence are kept. An empty table gives an empty result. Other columns are not read.
    """
    counts = metrics(stored(count_text(docs), "quality-counts"))  # small rows: read three times below, and the texts once
    # One row per language and source; the planner broadcasts it if its measured size allows.
    joined = counts.join(fences(counts), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = F.lit(False)
    for m in METRICS:
        beyond = beyond | F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False))
        if m in BOTH_SIDES:
            beyond = beyond | F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~beyond).alias("kept"),
    )


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """All documents under the base rules and the fences of their language and source."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
), g AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, w2, w3) >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id
), wc AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), lc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN lc USING (doc_id) LEFT JOIN rep USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars / greatest(n_words, 1)::DOUBLE AS m1, n_symbols / greatest(n_words, 1)::DOUBLE AS m2,
    n_dup_lines / greatest(n_lines, 1)::DOUBLE AS m3, n_repeat_words / greatest(n_words, 1)::DOUBLE AS m4 FROM c
), gr AS (
  SELECT lang AS gl, source AS gs, count(*)::DOUBLE AS n, quantile_disc(m1, [0.1, 0.5, 0.9]) AS q1, quantile_disc(m2, [0.5, 0.9]) AS q2,
    quantile_disc(m3, [0.5, 0.9]) AS q3, quantile_disc(m4, [0.5, 0.9]) AS q4
  FROM m WHERE NOT base_failed GROUP BY lang, source
), a AS (
  SELECT quantile_disc(m1, [0.1, 0.5, 0.9]) AS c1, quantile_disc(m2, [0.5, 0.9]) AS c2, quantile_disc(m3, [0.5, 0.9]) AS c3, quantile_disc(m4, [0.5, 0.9]) AS c4
  FROM m WHERE NOT base_failed
), s AS (
  SELECT gl, gs, (n * q1[1] + 100.0 * c1[1]) / (n + 100.0) AS l1, (n * q1[2] + 100.0 * c1[2]) / (n + 100.0) AS m1, (n * q1[3] + 100.0 * c1[3]) / (n + 100.0) AS h1,
    (n * q2[1] + 100.0 * c2[1]) / (n + 100.0) AS m2, (n * q2[2] + 100.0 * c2[2]) / (n + 100.0) AS h2,
    (n * q3[1] + 100.0 * c3[1]) / (n + 100.0) AS m3, (n * q3[2] + 100.0 * c3[2]) / (n + 100.0) AS h3,
    (n * q4[1] + 100.0 * c4[1]) / (n + 100.0) AS m4, (n * q4[2] + 100.0 * c4[2]) / (n + 100.0) AS h4 FROM gr, a
), f AS (
  SELECT gl, gs, l1 - 3.0 * greatest(m1 - l1, 0.1) AS low1, h1 + 3.0 * greatest(h1 - m1, 0.1) AS high1, h2 + 16.0 * greatest(h2 - m2, 0.015) AS high2,
    h3 + 16.0 * greatest(h3 - m3, 0.03) AS high3, h4 + 16.0 * greatest(h4 - m4, 0.015) AS high4 FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(m1 < low1, false) OR coalesce(m1 > high1, false) OR coalesce(m2 > high2, false)
    OR coalesce(m3 > high3, false) OR coalesce(m4 > high4, false)) AS kept
FROM m LEFT JOIN f ON lang IS NOT DISTINCT FROM gl AND source IS NOT DISTINCT FROM gs
"""
}
