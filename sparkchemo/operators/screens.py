"""Data screens: red flags, Jensen-Shannon divergence of classes, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkchemo.functions.expr import total
from sparkchemo.functions.lineage import cut_lineage
from sparkchemo.functions.quantiles import ordered_quantile
from sparkchemo.operators import forest
from sparkchemo.operators.attribution import attribute_nodes, shap_importance

EPSILON = 1e-12


def red_flags(df: DataFrame, columns: Sequence[str], label: str, least: int = 5, tol: float = 1e-12) -> DataFrame:
    """(check, cls, feature, found): nan, inf, zero_variance, min_obs, min_distinct, zero_class_variance and duplicates.

    One aggregate over all rows and one per class answer all checks but duplicates, which
    are whole rows that occur twice. A missing value counts as one further value.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    per = []
    for c in columns:
        x = F.when(finite(c), F.col(c))
        per += [F.coalesce(F.bool_or(F.isnan(c) | F.col(c).isNull()), F.lit(False)).alias(f"nan_{c}"), F.coalesce(F.bool_or(F.abs(F.col(c)) == float("inf")), F.lit(False)).alias(f"inf_{c}"), F.stddev_pop(x).alias(f"std_{c}")]
        per += [(F.count_distinct(x) + F.max(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0))).alias(f"kinds_{c}")]
    whole = df.agg(*per)
    by_class = df.groupBy(F.col(label).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n"), *per)

    def rows(table: DataFrame, name: str, cls: Column, found) -> DataFrame:
        picked = F.array(*[F.struct(F.lit(c).alias("feature"), found(c).alias("found")) for c in columns])
        return table.select(F.lit(name).alias("check"), cls.alias("cls"), F.explode(picked).alias("x")).select("check", "cls", "x.feature", "x.found")

    none = F.lit(None).cast("string")
    out = rows(whole, "nan", none, lambda c: F.col(f"nan_{c}"))
    out = out.union(rows(whole, "inf", none, lambda c: F.col(f"inf_{c}")))
    out = out.union(rows(whole, "zero_variance", none, lambda c: F.coalesce(F.col(f"std_{c}") < tol, F.lit(False))))
    out = out.union(by_class.select(F.lit("min_obs"), "cls", none, F.col("n") < least))
    out = out.union(rows(by_class, "min_distinct", F.col("cls"), lambda c: F.col(f"kinds_{c}") < least))
    guarded = lambda c: ~F.col(f"nan_{c}") & ~F.col(f"inf_{c}") & F.coalesce(F.col(f"std_{c}") < tol, F.lit(False))
    out = out.union(rows(by_class, "zero_class_variance", F.col("cls"), guarded))
    twice = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows")).agg(F.coalesce(F.max("_rows") > 1, F.lit(False)).alias("found"))
    return out.union(twice.select(F.lit("duplicates"), none, none, "found"))


def _long(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(F.col(label).cast("string").alias("cls"), F.explode(one).alias("o")).select("cls", "o.feature", "o.x").where("x is not null")


def feature_ranges(df: DataFrame, columns: Sequence[str], robust: bool = False) -> DataFrame:
    """(feature, lo, hi): least and greatest value, or the quartiles' fences inside them (midpoint rule)."""
    aggs = [F.min(c).cast("double").alias(f"lo_{c}") for c in columns] + [F.max(c).cast("double").alias(f"hi_{c}") for c in columns]
    row = df.agg(*aggs).first()
    spans = []
    for c in columns:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        if robust:
            a, b = ordered_quantile(df, c, 0.25, "midpoint"), ordered_quantile(df, c, 0.75, "midpoint")
            lo, hi = max(a - 1.5 * (b - a), lo), min(b + 1.5 * (b - a), hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        spans.append((c, lo, hi))
    return df.sparkSession.createDataFrame(spans, "feature string, lo double, hi double")


def histograms(df: DataFrame, columns: Sequence[str], label: str, bins: int = 25, robust: bool = False) -> DataFrame:
    """(feature, cls, bin, n): one pass; the last bin is closed, values outside the range are left out."""
    ranges = feature_ranges(df, columns, robust)
    x = _long(df, columns, label).join(F.broadcast(ranges), "feature").where("x between lo and hi")  # one row a feature
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    return x.select("feature", "cls", place.alias("bin")).groupBy("feature", "cls", "bin").agg(F.count(F.lit(1)).alias("n"))


def divergence(counts: DataFrame, features: Sequence[str], groups: dict[str, list[str]], bins: int) -> DataFrame:
    """(feature, grp, jsd) of each group of classes against all others, from one table of histograms.

    JSD is in bits; it is null if one side has no value in range.
    """
    spark = counts.sparkSession
    members = spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "grp string, cls string")
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    grid = spark.range(1).select(each(features).alias("feature")).select("feature", each(groups).alias("grp")).select("feature", "grp", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    own = counts.join(F.broadcast(members), "cls").groupBy("feature", "grp", "bin").agg(F.sum("n").alias("a"))  # the caller's list of groups
    both = counts.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    full = grid.join(own, ["feature", "grp", "bin"], "left").join(both, ["feature", "bin"], "left")
    full = full.select("feature", "grp", "bin", F.coalesce("a", F.lit(0)).alias("a"), (F.coalesce("n", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("b"))
    w = Window.partitionBy("feature", "grp")
    full = full.withColumns({"ta": F.sum("a").over(w), "tb": F.sum("b").over(w)}).where("ta > 0 and tb > 0")
    # Each side over its number of values, which leaves it a little above one with the shift, then normalised as entropies are.
    some = full.withColumns({"p": (F.col("a") + EPSILON) / F.col("ta"), "r": (F.col("b") + EPSILON) / F.col("tb")})
    sums = some.withColumn("m", (F.col("p") + F.col("r")) / 2).withColumns({f"s{k}": F.sum(k).over(w) for k in "prm"})
    term = lambda k: F.col(k) / F.col(f"s{k}") * F.log2((F.col(k) / F.col(f"s{k}")) / (F.col("m") / F.col("sm")))
    jsd = sums.groupBy("feature", "grp").agg((0.5 * F.sum(term("p")) + 0.5 * F.sum(term("r"))).alias("jsd"))
    return grid.select("feature", "grp").distinct().join(jsd, ["feature", "grp"], "left")


def class_groups(df: DataFrame, label: str, most: int = 1) -> dict[str, list[str]]:
    """All combinations of one to ``most`` classes, named by joining with ' AND '."""
    classes = sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect() if r[0] is not None)
    return {" AND ".join(g): list(g) for k in range(1, most + 1) for g in combinations(classes, k)}


def js_per_class(df: DataFrame, columns: Sequence[str], label: str, bins: int = 25, robust: bool = False) -> DataFrame:
    """(feature, cls, jsd): each class against the rest."""
    return divergence(histograms(df, columns, label, bins, robust), columns, class_groups(df, label), bins).withColumnRenamed("grp", "cls")


def js_select(per_class: DataFrame, top: int = 1, threshold: float = 0.0, by_class: bool = True) -> DataFrame:
    """The features ranked under ``top`` above ``threshold``: for some class, or by their mean over classes."""
    if by_class:
        rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc_nulls_last("jsd"), "feature"))
        return per_class.withColumn("rank", rank).where((F.col("rank") <= top) & (F.col("jsd") > threshold)).select("feature").distinct()
    return per_class.groupBy("feature").agg(F.avg("jsd").alias("jsd")).where(F.col("jsd") > threshold).orderBy(F.desc("jsd"), "feature").limit(top).select("feature")


def js_screen(df: DataFrame, columns: Sequence[str], label: str, most: int = 2, bins: int = 25, robust: bool = False) -> DataFrame:
    """(feature, grp, jsd) for all groups of up to ``most`` classes, from one set of histograms."""
    return divergence(histograms(df, columns, label, bins, robust), columns, class_groups(df, label, most), bins)


def js_incremental(grid: DataFrame, how: str = "max") -> DataFrame:
    """(grp, cls, delta, final): how a group's divergence changes by each member."""
    best = grid.groupBy("grp").agg((F.max if how == "max" else F.avg)("jsd").alias("final"))
    members = best.select("grp", "final", F.explode(F.split("grp", " AND ")).alias("cls")).where(F.col("grp").contains(" AND "))
    rest = F.array_join(F.array_remove(F.split("grp", " AND "), F.col("cls")), " AND ")
    before = best.select(F.col("grp").alias("rest"), F.col("final").alias("without"))
    out = members.withColumn("rest", rest).join(before, "rest").select("grp", "cls", (F.col("final") - F.col("without")).alias("delta"), "final")
    single = best.where(~F.col("grp").contains(" AND ")).select(F.col("grp").alias("cls"), F.col("final").alias("alone"))
    return out.join(single, "cls").select("grp", "cls", "delta", "final", "alone")


def js_interesting(steps: DataFrame, threshold: float = 0.7, least: float = 0.0) -> DataFrame:
    """Groups that pass the threshold only together: every member's own value is well below."""
    ok = (F.col("final") > threshold) & (F.col("final") - F.col("delta") < threshold) & (F.col("delta") > least)
    low = F.max("alone") < F.max("final") - least
    return steps.groupBy("grp").agg(F.bool_or(ok).alias("ok"), low.alias("low"), F.max("final").alias("final")).where("ok and low").select("grp", "final")


def js_pairs(df: DataFrame, columns: Sequence[str], label: str, bins: int = 25) -> DataFrame:
    """(a, b, feature, jsd): for each pair of classes the most divergent feature, ranges taken from the pair's rows."""
    long = _long(df, columns, label)
    spans = long.groupBy("feature", "cls").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    two = spans.alias("s").join(spans.alias("t"), (F.col("s.feature") == F.col("t.feature")) & (F.col("s.cls") < F.col("t.cls")))
    pairs = two.select(F.col("s.feature").alias("feature"), F.col("s.cls").alias("a"), F.col("t.cls").alias("b"), F.least("s.lo", "t.lo").alias("lo"), F.greatest("s.hi", "t.hi").alias("hi"))
    pairs = pairs.withColumns({"lo": F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))})
    sides = pairs.select("*", F.explode(F.array(F.col("a"), F.col("b"))).alias("cls"))  # classes squared x features
    place = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = long.join(F.broadcast(sides), ["feature", "cls"]).groupBy("a", "b", "feature", place.alias("bin")).agg(F.count(F.when(F.col("cls") == F.col("a"), 1)).alias("na"), F.count(F.when(F.col("cls") == F.col("b"), 1)).alias("nb"))
    grid = pairs.select("a", "b", "feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, ["a", "b", "feature", "bin"], "left").fillna(0)
    w = Window.partitionBy("a", "b", "feature")
    p = grid.withColumns({"p": (F.col("na") + EPSILON) / F.sum("na").over(w), "r": (F.col("nb") + EPSILON) / F.sum("nb").over(w)}).withColumn("m", (F.col("p") + F.col("r")) / 2)
    p = p.withColumns({f"s{k}": F.sum(k).over(w) for k in "prm"})
    term = lambda k: F.col(k) / F.col(f"s{k}") * F.log2((F.col(k) / F.col(f"s{k}")) / (F.col("m") / F.col("sm")))
    each = p.groupBy("a", "b", "feature").agg((0.5 * F.sum(term("p")) + 0.5 * F.sum(term("r"))).alias("jsd"))
    return each.groupBy("a", "b").agg(F.max(F.struct("jsd", "feature")).alias("m")).select("a", "b", "m.feature", "m.jsd")


#: Different values of a column up to which its ranks are broadcast.
FEW = 10_000


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(r_<column>...): ranks with ties averaged, a row for each of ``df``; null is a value, the least.

    Distinct values of all columns are counted. Ranks of columns with at most FEW of them are broadcast to the rows. Values of the
    other columns are dealt by range and the parts numbered by their sizes, so no task sees a whole column, and each of
    these columns is a join on its values, in which a frequent one can be split. Rows are never taken apart by column.
    """
    one = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.explode(one).alias("x")).select("x.f", "x.v")
    counts = cut_lineage(long.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")))
    different = {r["f"]: r["n"] for r in counts.groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = [i for i in range(len(columns)) if different.get(i, 0) > FEW]
    rows = df.select(*[F.col(c).cast("double").alias(f"r_{c}") for c in columns])
    ranks = None
    if many:
        values = cut_lineage(counts.where(F.col("f").isin(many)).repartitionByRange("f", "v").withColumn("part", F.spark_partition_id()))
        sizes = values.groupBy("part", "f").agg(F.sum("n").alias("n"))
        ahead = sizes.select("part", "f", (F.sum("n").over(Window.partitionBy("f").orderBy("part")) - F.col("n")).alias("ahead"))
        inside = F.sum("n").over(Window.partitionBy("part", "f").orderBy("v"))
        ranks = cut_lineage(values.join(F.broadcast(ahead), ["part", "f"]).select("f", "v", (F.col("ahead") + inside - (F.col("n") - 1) / 2).alias("r")))
    for i in [*many, *(i for i in range(len(columns)) if i not in many)]:  # joins that shuffle come first
        name = f"r_{columns[i]}"
        if i in many:
            own = ranks.where(F.col("f") == i).select(F.col("v").alias("_v"), F.col("r").alias("_r"))
        else:
            few = counts.where(F.col("f") == i)
            own = F.broadcast(few.select(F.col("v").alias("_v"), (F.sum("n").over(Window.orderBy("v")) - (F.col("n") - 1) / 2).alias("_r")))  # FEW rows at most
        rows = rows.join(own, F.col(name).eqNullSafe(F.col("_v"))).withColumn(name, F.col("_r")).drop("_v", "_r")
    return rows


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for all pairs a < b: the correlation of average ranks."""
    ranked = average_ranks(df, columns)
    pairs = list(combinations(columns, 2))
    row = ranked.agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(made).alias("x")).select("x.*")


def ward_clusters(distance, cut: float | None = None) -> list[int]:
    """Cluster numbers of a small distance matrix by Ward's linkage, cut at ``cut`` or the root of the greatest height.

    Ties join the lowest indexes first; clusters are numbered by their first member.
    """
    n = len(distance)
    d = {(i, j): float(distance[i][j]) for i in range(n) for j in range(i)}
    d = {tuple(sorted(k)): v for k, v in d.items()}
    size, alive, steps = dict.fromkeys(range(n), 1), set(range(n)), []
    while len(alive) > 1:
        i, j = min((k for k in d if k[0] in alive and k[1] in alive), key=lambda k: (d[k], k))
        new = n + len(steps)
        for k in alive - {i, j}:
            a, b, c = d[tuple(sorted((i, k)))], d[tuple(sorted((j, k)))], d[i, j]
            total = size[i] + size[j] + size[k]
            d[k, new] = (((size[i] + size[k]) * a * a + (size[j] + size[k]) * b * b - size[k] * c * c) / total) ** 0.5
        steps.append((i, j, d[i, j]))
        size[new] = size[i] + size[j]
        alive = alive - {i, j} | {new}
    top = max((h for *_, h in steps), default=0.0)
    cut = top**0.5 if cut is None else cut
    group = {i: [i] for i in range(n)}
    for k, (i, j, h) in enumerate(steps):
        if h <= cut and i in group and j in group:
            group[n + k] = group.pop(i) + group.pop(j)
    numbers = [0] * n
    for c, members in enumerate(sorted(group.values(), key=min)):
        for m in members:
            numbers[m] = c
    return numbers


def select_collinear(df: DataFrame, columns: Sequence[str], cut: float | None = None) -> list[str]:
    """The first column of each cluster of rank-correlated ones (distance 1 - |rho|)."""
    rho = {(r["a"], r["b"]): r["rho"] for r in spearman(df, columns).collect()}
    dist = [[0.0 if a == b else 1 - abs(rho.get((a, b), rho.get((b, a))) or 0.0) for b in columns] for a in columns]
    numbers = ward_clusters(dist, cut)
    return [c for i, c in enumerate(columns) if numbers.index(numbers[i]) == i]


def close_pairs(df: DataFrame, columns: Sequence[str], key: str, tol: float) -> DataFrame:
    """(a, b), a < b: rows whose columns are less than ``tol`` apart; rows with equal columns count once, for their least key.

    Cells of len(columns) + 1 shifted grids are hashed: a column splits two near rows in at
    most one of the grids, so they share a cell of some grid whole, and only rows of a cell are compared.
    """
    p = len(columns)
    width = 2.0 * tol * (p + 1)
    one = df.groupBy(*columns).agg(F.min(key).alias("_key"))
    cell = lambda g: F.xxhash64(F.lit(g), *[F.floor(F.col(c) / width + g / (p + 1)) for c in columns])
    placed = one.withColumn("_cell", F.explode(F.array(*[cell(g) for g in range(p + 1)])))
    other = placed.select("_cell", F.col("_key").alias("_other"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    near = F.sqrt(total([F.pow(F.col(c) - F.col(f"_o_{c}"), 2) for c in columns])) < tol
    met = placed.join(other, "_cell").where((F.col("_key") < F.col("_other")) & near)
    return met.select(F.col("_key").alias("a"), F.col("_other").alias("b")).distinct()


def relabel(df: DataFrame, label: str, groups: Sequence[str]) -> DataFrame:
    """``df`` with the classes of each group, named as in ``class_groups``, under the group's name; others keep theirs."""
    out = F.col(label)
    for g in groups:
        out = F.when(F.col(label).isin(g.split(" AND ")), F.lit(g)).otherwise(out)
    return df.withColumn(label, out)


def group_table(grid: DataFrame, how: str = "max") -> DataFrame:
    """(grp, best, deviation): each group's best or mean divergence over the features, and their deviation."""
    return grid.groupBy("grp").agg((F.max if how == "max" else F.avg)("jsd").alias("best"), F.stddev_pop("jsd").alias("deviation"))


def best_feature_histograms(df: DataFrame, columns: Sequence[str], label: str, grid: DataFrame, bins: int = 25) -> DataFrame:
    """(grp, feature, bin, inside, n): for each group the histograms of its most divergent feature, in the group and outside."""
    best = grid.groupBy("grp").agg(F.max(F.struct("jsd", "feature")).alias("m")).select("grp", "m.feature")
    counts = histograms(df, columns, label, bins).join(F.broadcast(best), "feature")  # a row a group
    inside = F.array_contains(F.split("grp", " AND "), F.col("cls"))
    return counts.groupBy("grp", "feature", "bin", inside.alias("inside")).agg(F.sum("n").alias("n"))


def least_label_entropy(df: DataFrame, clusters: dict[int, list[str]], labels: dict[str, str], share: float = 0.9, restarts: int = 20, seed: int = 0) -> list[str]:
    """One column of each cluster so that the chosen columns' labels have the least entropy found.

    Columns with values in at most ``share`` of the rows are left out. From random choices,
    each cluster in turn takes the column that lowers the entropy most until none does; the
    best of the restarts wins, the first by name among equals.
    """
    import math
    import random
    from collections import Counter

    columns = [c for own in clusters.values() for c in own]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    safe = [sorted(c for c in own if row[c] > int(row["_n"] * share)) for _, own in sorted(clusters.items())]
    if not all(safe):
        raise ValueError("a cluster has no column with values in enough rows")

    def entropy(chosen: list[str]) -> float:
        return -sum(n / len(chosen) * math.log(n / len(chosen)) for n in Counter(labels[c] for c in chosen).values())

    rng, best = random.Random(seed), None
    for _ in range(restarts):
        chosen = [rng.choice(own) for own in safe]
        now, before = entropy(chosen), math.inf
        while now < before - 1e-12:
            before = now
            for i, own in enumerate(safe):
                chosen[i] = min(own, key=lambda c: (entropy([*chosen[:i], c, *chosen[i + 1 :]]), c))  # noqa: B023
            now = entropy(chosen)
        best = min(best or (now, chosen), (now, chosen))
    return best[1]


def shadows(df: DataFrame, columns: Sequence[str], seed: int) -> DataFrame:
    """``df`` with s_<column>: each column's values in another order, within random buckets of about 50,000 rows.

    One shuffle for all columns. A bucket's rows are sorted before they are mixed, so a task that is run
    again gives the same.
    """
    buckets = max(1, df.count() // 50_000)
    names, kept = list(columns), df.columns
    rows = df.select(*kept, *[F.col(c).cast("double").alias(f"s_{c}") for c in names])
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))

    def mix(table: pa.Table) -> pa.Table:
        own = [table.column(f"s_{c}").to_numpy() for c in names]
        order = np.lexsort(own)
        table = table.take(pa.array(order))
        rng = np.random.default_rng([seed, table.column("_b")[0].as_py()])
        for c, v in zip(names, own, strict=True):
            table = table.set_column(table.schema.get_field_index(f"s_{c}"), f"s_{c}", pa.array(v[order][rng.permutation(len(v))], from_pandas=True))
        return table.drop_columns(["_b"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_b").schema)
    return rows.groupBy("_b").applyInArrow(mix, kinds)


def boruta(
    df: DataFrame, columns: Sequence[str], label: str, trials: int = 20, alpha: float = 0.05, seed: int = 0, trees: int = 40, depth: int = 5, percentile: float = 100, importance: str = "shap"
) -> DataFrame:
    """(feature, hits, trials, status): columns whose importance in a random forest beats that of the shadows.

    In each trial a random forest sees the columns and their shadows, which cannot tell the
    classes; a hit is an importance above the ``percentile`` of the shadows' (100: above all). ``importance`` is 'shap', the mean
    absolute SHAP value over all rows, or 'impurity', the forest's own. Too many hits to be a fair
    coin's make a column 'accepted', too few 'rejected' (binomial, corrected for the number of
    columns), else it is 'tentative'. Rows with a null in a column or no label are left out.
    """
    from math import comb

    from pyspark.ml.feature import StringIndexer

    if importance not in ("shap", "impurity"):
        raise ValueError("importance is 'shap' or 'impurity'")
    rows = df.select(label, *columns).dropna()
    named = StringIndexer(inputCol=label, outputCol="_y").fit(rows)
    # Rows are read and coded once; a trial reads its blocks once a level and for the values.
    coded = forest.code(named.transform(rows), columns, "_y", len(named.labels))
    features = [*columns, *[f"s_{c}" for c in columns]]
    hits = dict.fromkeys(columns, 0)
    for t in range(trials):
        mixed = forest.mixed(coded, seed + 2 * t, trees).persist()
        try:
            grown = forest.grow(mixed, coded, trees, depth, seed + t)
            if importance == "shap":
                by = {r["feature"]: r["importance"] for r in shap_importance(attribute_nodes(forest.node_rows(grown)), mixed, features).collect()}
                found = np.array([by[c] for c in features])
            else:
                found = forest.impurity_importance(grown, len(features))
        finally:
            mixed.unpersist()
        limit = np.percentile(found[len(columns) :], percentile)
        for c, v in zip(columns, found, strict=False):
            hits[c] += int(v > limit)
    tail = lambda k: sum(comb(trials, i) for i in range(k, trials + 1)) / 2**trials
    limit = alpha / len(columns)
    status = {c: "accepted" if tail(h) < limit else "rejected" if tail(trials - h) < limit else "tentative" for c, h in hits.items()}
    return df.sparkSession.createDataFrame([(c, h, trials, status[c]) for c, h in hits.items()], "feature string, hits int, trials int, status string")
