"""Class rebalancing: SMOTE and edited nearest neighbours over scaled columns.

Neighbours are exact, from a join over boxes of a tree that looks only where a neighbour can be.
Distances are in the columns that the caller passes, scaled or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.functions.expr import uniform
from sparkchemo.functions.lineage import cut_lineage
from sparkchemo.operators.comparison import in_random_order
from sparkchemo.operators.neighbours import nearest, neighbours, rows_of
from sparkchemo.operators.scaling import CorrectedScaler


def smote(df: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 5, seed: int = 0, named: bool = False) -> DataFrame:
    """``df`` (key, columns, label) and made-up rows until all classes are as many as the largest.

    A made-up row lies between a row of its class and one of its ``k`` nearest there, at a
    place that follows from the seed; its key is null, or with ``named`` a text that names its
    source (and all keys become text). How many each row gives is even.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    top = max(sizes.values())
    small = [c for c, n in sizes.items() if n < top]
    if not small:
        return df.select(F.col(key).cast("string" if named else df.schema[key].dataType).alias(key), *columns, label)
    rows = df.where(F.col(label).isin(small))
    near = neighbours(rows, rows, columns, key, k, label, within=True)
    lists = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "x"))).alias("near"))  # k entries
    want = F.lit(0)
    for c in small:
        each, more = divmod(top - sizes[c], sizes[c])
        # ``more`` of the class's rows by hash give one further row.
        want = F.when(F.col(label) == c, F.lit(each) + (F.col("_place") < more).cast("int")).otherwise(want)
    placed = in_random_order(rows, label, [key], seed).withColumnRenamed("_k", "_place")
    give = placed.withColumn("_want", want).where("_want > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_want"))))
    give = give.join(lists, F.col(key) == F.col("q"))
    pick = F.get("near", F.floor(uniform(seed, F.col(key), F.col("_copy"), F.lit("pick")) * F.size("near")).cast("int"))
    u = uniform(seed, F.col(key), F.col("_copy"), F.lit("step"))
    made_key = F.concat(F.lit("made-"), F.col(key).cast("string"), F.lit("-"), F.col("_copy").cast("string")) if named else F.lit(None).cast(df.schema[key].dataType)
    made = give.select(made_key.alias(key), *[(F.col(c) + u * (pick["x"][i] - F.col(c))).alias(c) for i, c in enumerate(columns)], label)
    return df.select(F.col(key).cast(made.schema[key].dataType).alias(key), *columns, label).union(made)


def edited_neighbours(df: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 3, kind: str = "all", spare: str | None = None) -> DataFrame:
    """``df`` without rows whose ``k`` neighbours disagree with their class: any of them ('all') or most ('mode').

    ``spare`` is a class that loses nothing (the smallest unless given).
    """
    if spare is None:
        spare = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy("n", label).first()[label]
    rows = rows_of(df, columns, key, label, F.coalesce(F.col(label) != spare, F.lit(False)), True)
    agree = lambda near, own: F.size(F.filter(near, lambda n: n["label"] == own))
    bad = lambda near, own: (F.size(near) > 0) & (agree(near, own) < k if kind == "all" else 2 * agree(near, own) < k)
    gone = nearest(rows, k, bad, places=False).where("value").select(F.col("q").alias(key))
    return df.join(gone, key, "left_anti")


def scaled_smote_enn(df: DataFrame, columns: Sequence[str], label: str, key: str, k_smote: int = 5, k_enn: int = 3, kind: str = "all", spare: str = "", seed: int = 0) -> DataFrame:
    """SMOTE, then edited neighbours, both in standardised columns; the result is in the original units.

    The columns are brought to the first one's deviation, which is the same but for a common factor and leaves the first column as
    it is: its rounding would order neighbours that are about as far. Keys become text; made-up rows name their source. No
    class is spared unless ``spare`` names it.
    """
    first, *rest = CorrectedScaler(columns).fit(df).scale
    factor = dict(zip(columns[1:], (first / s for s in rest), strict=True))
    scaled = df.select(key, *columns, label).withColumns({c: F.col(c) * F.lit(f) for c, f in factor.items()})
    whole = cut_lineage(smote(scaled, columns, label, key, k_smote, seed, named=True))
    return edited_neighbours(whole, columns, label, key, k_enn, kind, spare).withColumns({c: F.col(c) / F.lit(f) for c, f in factor.items()})
