"""Figures of merit from (actual, predicted) rows: counts first, then rates over the small table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n); ``predicted`` is a string or, for soft models, an array of strings."""
    soft = df.schema[predicted].dataType.typeName() == "array"
    p = F.explode(predicted) if soft else F.col(predicted)
    return df.select(F.col(actual).alias("actual"), p.alias("predicted")).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_merit(df: DataFrame, actual: str, predicted: str, trained: Sequence[str]) -> DataFrame:
    """(cls, csns, csps, ceff) of each trained class; undefined sensitivities are null and ceff is then csps."""
    size = df.groupBy(F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("rows"))
    cm = confusion(df, actual, predicted)
    cells = size.select("actual", "rows", F.explode(F.array(*[F.lit(c) for c in trained])).alias("cls")).join(cm.withColumnRenamed("predicted", "cls"), ["actual", "cls"], "left").fillna(0, ["n"])
    own = F.col("actual") == F.col("cls")
    out = cells.groupBy("cls").agg(
        F.try_divide(F.sum(F.when(own, F.col("n"))), F.sum(F.when(own, F.col("rows")))).alias("csns"),
        (1 - F.try_divide(F.sum(F.when(~own, F.col("n")).otherwise(0)), F.sum(F.when(~own, F.col("rows")).otherwise(0)))).alias("csps"),
    )
    return out.withColumn("ceff", F.coalesce(F.sqrt(F.col("csns") * F.col("csps")), "csps"))


def total_merit(df: DataFrame, actual: str, predicted: str, trained: Sequence[str], unknown: str, soft: bool = False) -> DataFrame:
    """One row: tsns, tsps, teff, acc. In soft mode tsps is shared out over K - 1 further classes."""
    cm = confusion(df, actual, predicted)
    known = list(trained)
    n = df.count()
    is_known = F.col("actual").isin(known)
    share = len(known) - 1 if soft else 1
    sums = cm.agg(
        F.sum(F.when(is_known & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("predicted").isin(known), F.col("n")).otherwise(0)).alias("assigned"),
        F.sum(F.when(~is_known & (F.col("predicted") == unknown), F.col("n")).otherwise(0)).alias("rejected"),
    )
    rows = df.agg(F.sum(F.when(F.col(actual).isin(known), 1).otherwise(0)).alias("known_rows"))
    both = sums.select("*", F.lit(1).alias("k")).join(rows.select("*", F.lit(1).alias("k")), "k")
    tsns = F.try_divide(F.col("hit"), F.col("known_rows"))
    tsps = 1 - F.try_divide(F.try_divide(F.col("assigned") - F.col("hit"), F.lit(n)), F.lit(share))
    out = both.select(tsns.alias("tsns"), tsps.alias("tsps"), F.try_divide(F.col("hit") + F.col("rejected"), F.lit(n)).alias("acc"))
    return out.withColumn("teff", F.coalesce(F.sqrt(F.col("tsns") * F.col("tsps")), "tsps"))


def one_class_merit(df: DataFrame, actual: str, inlier: str, target: str) -> DataFrame:
    """(cls, csps) of each alternative and, with cls null, tsns, tsps, teff and acc: one scan of the rows."""
    per = df.groupBy(F.col(actual).alias("cls")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(inlier).cast("long")).alias("taken"))
    own = F.col("cls") == target
    each = per.where(~own).select("cls", (1 - F.col("taken") / F.col("rows")).alias("csps"), *[F.lit(None).cast("double").alias(c) for c in ("tsns", "tsps", "teff", "acc")])
    part = lambda c, w: F.sum(F.when(w, F.col(c)).otherwise(0))
    whole = per.agg(
        F.try_divide(part("taken", own), part("rows", own)).alias("tsns"),
        (1 - F.try_divide(part("taken", ~own), part("rows", ~own))).alias("tsps"),
        F.try_divide(part("taken", own) + part("rows", ~own) - part("taken", ~own), F.sum("rows")).alias("acc"),
    )
    whole = whole.select(F.lit(None).cast("string").alias("cls"), F.lit(None).cast("double").alias("csps"), "tsns", "tsps", F.coalesce(F.sqrt(F.col("tsns") * F.col("tsps")), "tsns", "tsps").alias("teff"), "acc")
    return each.unionByName(whole)
