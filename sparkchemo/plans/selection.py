"""Queries of model selection and neighbours, with the same in SQL: over all rows for each split, over all pairs of rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkchemo.operators import attribution, explain, neighbours, rebalance, screens, search, spectra
from sparkchemo.operators.mcd import minimum_covariance
from sparkchemo.operators.projection import PCA, PLSDA, Authenticator, Ellipse, LatentRegression
from sparkchemo.operators.scaling import CorrectedScaler
from sparkchemo.plans.catalogue import ELLIPSE_SQL, FEATURES, LABEL, ROW, V_SQL, lines, query, rounded, spectra_of
from sparkchemo.sources.tables import table

PRICE = ["l_quantity", "l_discount", "l_tax"]
SPACE = {"columns": [PRICE, PRICE[1:], PRICE[:2]], "scale": [False, True]}
DRAWN = search.draw(SPACE, 3, seed=4)


def nested_sql(settings: list[dict], rest: str) -> str:
    """One-component PLS of each setting on every training set, held against every held-out set; ``rest`` reads ``r`` and ``m``."""
    flags = ", ".join(f"({s}, {', '.join(str(int(c in one['columns'])) for c in PRICE)}, {one['scale']})" for s, one in enumerate(settings))
    pairs = [(j, k) for j in range(3) for k in range(3)]
    cov = lambda j, k: f"c{min(j, k)}{max(j, k)}"
    return f"""WITH l AS (SELECT l_orderkey % 5 AS o, l_partkey % 4 AS i, l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2, l_extendedprice::DOUBLE AS y FROM lineitem),
p AS (SELECT o, unnest([-1, 0, 1, 2, 3]) AS i FROM (SELECT unnest(range(0, 5)) AS o)),
t AS (SELECT p.o, p.i, avg(y) AS y0, {", ".join(f"avg(x{j}) AS m{j}, covar_samp(x{j}, y) AS w{j}" for j in range(3))}, {", ".join(f"covar_samp(x{j}, x{k}) AS c{j}{k}" for j, k in pairs if j <= k)} FROM p JOIN l ON l.o <> p.o AND l.i <> p.i GROUP BY p.o, p.i),
f AS (SELECT * FROM (VALUES {flags}) AS v(s, u0, u1, u2, scale)),
a AS (SELECT t.*, s, {", ".join(f"CASE WHEN scale THEN sqrt(c{j}{j}) ELSE 1 END AS s{j}, u{j} * w{j} / CASE WHEN scale THEN sqrt(c{j}{j}) ELSE 1 END AS d{j}" for j in range(3))} FROM t, f),
b AS (SELECT *, (d0 * d0 + d1 * d1 + d2 * d2) / ({" + ".join(f"d{j} * d{k} * {cov(j, k)} / (s{j} * s{k})" for j, k in pairs)}) AS g FROM a),
r AS (
  SELECT b.o, b.i, b.s, 1 - sum((y - y0 - g * ({" + ".join(f"d{j} / s{j} * (x{j} - m{j})" for j in range(3))})) ** 2) / (var_pop(y) * count(*)) AS score
  FROM b JOIN l ON CASE WHEN b.i < 0 THEN l.o = b.o ELSE l.o <> b.o AND l.i = b.i END GROUP BY b.o, b.i, b.s
), m AS (SELECT o, s, avg(score) AS mean, row_number() OVER (PARTITION BY o ORDER BY avg(score) DESC, s) = 1 AS chosen FROM r WHERE i >= 0 GROUP BY o, s)
{rest}"""


_TABLE = "SELECT m.o::INT AS outer_fold, m.s::INT AS setting, round(mean, 4) + 0.0 AS mean, chosen, CASE WHEN chosen THEN round(score, 4) + 0.0 END AS outer_score FROM m JOIN r ON r.o = m.o AND r.s = m.s AND r.i < 0"


def _searched(spark, d, settings):
    df = table(spark, d, "lineitem").select(*PRICE, "l_extendedprice", (F.col("l_orderkey") % 5).cast("int").alias("outer"), (F.col("l_partkey") % 4).cast("int").alias("inner"))
    return search.nested_search(df, LatentRegression(PRICE, "l_extendedprice", 1), settings)


def _shown(found):
    return rounded(found.select(F.col("outer").alias("outer_fold"), "setting", "mean", "chosen", "outer_score"))


@query(nested_sql(search.grid(SPACE), _TABLE))
def nested_grid_search(spark, d):
    """Six settings of a one-component regression in five outer folds of four inner ones."""
    return _shown(_searched(spark, d, search.grid(SPACE)))


@query(nested_sql(DRAWN, _TABLE))
def nested_random_search(spark, d):
    """Three settings drawn by a seed."""
    return _shown(_searched(spark, d, DRAWN))


@query(nested_sql(search.grid(SPACE), "SELECT 'pls1' AS estimator, m.o::INT AS repeat, r.i::INT AS fold, round(score, 4) + 0.0 AS score FROM m JOIN r ON r.o = m.o AND r.s = m.s AND chosen AND r.i >= 0"))
def nested_validation_scores(spark, d):
    """The chosen settings' validation scores, as the paired tests take them."""
    return rounded(search.validation_scores(_searched(spark, d, search.grid(SPACE)), "pls1"))


@query()
def nested_plsda_search(spark, d):
    """Components and scaling of PLS-DA by the share of right classes; tests hold it against a fit for each split."""
    df = search.nested_folds(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES, LABEL), ["l_orderkey", "l_linenumber", *FEATURES], 4, 3)
    return search.nested_search(df, PLSDA(FEATURES, LABEL), search.grid({"n_components": [2, 3, 4], "scale": [True, False]}))


# --- neighbours -------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT p_partkey AS k, p_size * 20.0 AS x, p_retailprice AS y FROM part),
n AS (SELECT a.k, b.k AS o, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d FROM p a JOIN p b ON a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, o) AS rank FROM n)
SELECT k AS p_partkey, rank::INT AS rank, o AS neighbour, round(d, 2) + 0.0 AS gap FROM r WHERE rank <= 3"""
)
def nearest_parts(spark, d):
    """The three nearest parts to each by size and price."""
    df = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 20.0).alias("x"), F.col("p_retailprice").alias("y"))
    near = neighbours.neighbours(df, df, ["x", "y"], "p_partkey", 3)
    return rounded(near.select(F.col("q").alias("p_partkey"), "rank", F.col("id").alias("neighbour"), F.col("d").alias("gap")), 2)


@query(
    """WITH s AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey * 100.0 AS y, c_mktsegment AS cls FROM customer), sp AS (SELECT cls FROM s GROUP BY cls ORDER BY count(*), cls LIMIT 1),
n AS (SELECT a.k, a.cls, b.cls AS vote, row_number() OVER (PARTITION BY a.k ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.k) AS r FROM s a JOIN s b ON a.k <> b.k WHERE a.cls NOT IN (SELECT cls FROM sp)),
g AS (SELECT k FROM n WHERE r <= 3 GROUP BY k HAVING 2 * count(*) FILTER (vote = cls) < 3)
SELECT k AS c_custkey, cls AS c_mktsegment FROM s WHERE k NOT IN (SELECT k FROM g)"""
)
def edited_customers(spark, d):
    """Customers whose segment is not outvoted by their three nearest, in two columns."""
    df = table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") * 100.0).alias("y"), "c_mktsegment")
    return rebalance.edited_neighbours(df, ["c_acctbal", "y"], "c_mktsegment", "c_custkey", kind="mode").select("c_custkey", "c_mktsegment")


@query()
def edited_lineitem(spark, d):
    """Edited neighbours of all line items in four standardised columns: rows left by class; SQL would need all pairs."""
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", *ROW, *FEATURES, LABEL).alias("id"), *FEATURES, LABEL)
    df = CorrectedScaler(FEATURES).fit(rows).transform(rows)
    return rebalance.edited_neighbours(df, FEATURES, LABEL, "id", kind="mode").groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


# --- robust covariance ------------------------------------------------------------------------------------------

#: In one dimension the half of least variance is a stretch of the sorted rows, so SQL finds it among all of them. Fixed
#: values: the chi-squared quantiles of one degree of freedom at 0.5 and 0.975.
MCD_SQL = """WITH x AS (SELECT (l_extendedprice / 1000) ** 2 AS x, l_returnflag, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem),
c AS (SELECT *, (n + 3) // 2 AS h, x - avg(x) OVER () AS z FROM x),
s AS (SELECT *, sum(z) OVER (ORDER BY i) AS s1, sum(z * z) OVER (ORDER BY i) AS s2 FROM c),
w AS (SELECT b.i, (b.s2 - coalesce(a.s2, 0)) / b.h - ((b.s1 - coalesce(a.s1, 0)) / b.h) ** 2 AS v FROM s b LEFT JOIN s a ON a.i = b.i - b.h WHERE b.i >= b.h),
best AS (SELECT arg_min(i, v) AS i FROM w), core AS (SELECT avg(x) AS m, var_pop(x) AS v FROM c, best WHERE c.i <= best.i AND c.i > best.i - h),
raw AS (SELECT any_value(m) AS m, quantile_cont((x - m) ** 2, 0.5) / 0.45493642311957283 AS v FROM x, core),
fin AS (SELECT avg(x) AS m, var_pop(x) AS v FROM x, raw WHERE (x - raw.m) ** 2 / raw.v < 5.023886187314888)
"""


def squares(spark, d):
    return table(spark, d, "lineitem").select(F.pow(F.col("l_extendedprice") / 1000, 2).alias("x"), LABEL)


@query(MCD_SQL + "SELECT round(raw.m, 2) + 0.0 AS raw_location, round(sqrt(raw.v), 2) + 0.0 AS raw_scale, round(fin.m, 2) + 0.0 AS location, round(sqrt(fin.v), 2) + 0.0 AS scale FROM raw, fin")
def mcd_price(spark, d):
    """The robust location and scale of the squared prices, which crowd at their low end."""
    raw, final = minimum_covariance(squares(spark, d), ["x"])
    row = [float(v) for s in (raw, final) for v in (s.location[0], s.covariance[0, 0] ** 0.5)]
    return rounded(spark.createDataFrame([row], "raw_location double, raw_scale double, location double, scale double"), 2)


@query(MCD_SQL + "SELECT l_returnflag, (x - fin.m) ** 2 / fin.v <= 3.841458820694124 AS inlier, count(*) AS n FROM x, fin GROUP BY 1, 2")
def mcd_limits(spark, d):
    """Line items inside and outside the robust limits of the squared price, by class."""
    df = squares(spark, d)
    return Ellipse(["x"], robust="mcd").fit(df).score(df).groupBy(LABEL, "inlier").agg(F.count(F.lit(1)).alias("n"))


# --- attributions -----------------------------------------------------------------------------------------------


@query()
def shap_lineitem(spark, d):
    """The mean absolute SHAP value of each column in a forest for the return flag; tests enumerate feature subsets."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = table(spark, d, "lineitem").select(*FEATURES, LABEL)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(StringIndexer(inputCol=LABEL, outputCol="y", stringOrderType="alphabetAsc").fit(df).transform(df))
    forest = RandomForestClassifier(labelCol="y", featuresCol="v", numTrees=10, maxDepth=4, seed=1).fit(rows)
    return rounded(attribution.shap_importance(attribution.attribute(forest, spark), df, FEATURES))


@query()
def boruta_lineitem(spark, d):
    """Columns that tell dear lines from cheap ones better than their shadows do: the price, by which they are told."""
    df = table(spark, d, "lineitem").select(*FEATURES, F.when(F.col("l_extendedprice") > 50_000, "dear").otherwise("cheap").alias("kind"))
    return screens.boruta(df, FEATURES, "kind", trials=8, trees=10, depth=4)


# --- images -----------------------------------------------------------------------------------------------------

#: Four by four places of four channels; the gradients are the same numbers, places and channels exchanged.
MAP_SQL = """WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS z, unnest(embedding)::DOUBLE AS v FROM embeddings),
a AS (SELECT vec_id, z // 16 AS r, z // 4 % 4 AS c, z % 4 AS ch, v FROM l), g AS (SELECT vec_id, z // 4 % 4 AS r, z % 4 AS c, z // 16 AS ch, v FROM l),
w AS (SELECT a.vec_id, a.r, a.c, sum(a.v * g.v) AS v FROM a JOIN g USING (vec_id, r, c, ch) GROUP BY ALL),
s AS (SELECT w.vec_id, w.r, w.c, greatest(0, (w.v + t.v) / 2) AS v FROM w JOIN w t ON t.vec_id = w.vec_id AND t.r = w.c AND t.c = w.r),
m AS (SELECT vec_id, r, c, v / nullif(max(v) OVER (PARTITION BY vec_id), 0) AS v FROM s)
"""


def maps(spark, d):
    at = lambda i: F.col("embedding")[i].cast("double")
    image = lambda place: F.array(*[F.array(*[F.array(*[at(place(r, c, ch)) for ch in range(4)]) for c in range(4)]) for r in range(4)])
    found = explain.activation_map_2d(image(lambda r, c, ch: 16 * r + 4 * c + ch), image(lambda r, c, ch: 16 * ch + 4 * r + c))
    return table(spark, d, "embeddings").select("vec_id", found.alias("map"))


@query(
    MAP_SQL
    + """, p AS (SELECT i, k, greatest(0, 1 - abs(k + 0.5 - (i + 0.5) * 4 / 10.0)) AS w FROM (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 4)) AS k)),
n AS (SELECT i, k, w / sum(w) OVER (PARTITION BY i) AS w FROM p)
SELECT vec_id, a.i AS r, b.i AS c, round(sum(a.w * b.w * v), 5) + 0.0 AS v FROM m JOIN n a ON a.k = m.r JOIN n b ON b.k = m.c WHERE v IS NOT NULL GROUP BY ALL"""
)
def activation_image(spark, d):
    """Symmetric activation maps of four by four places, stretched to ten by ten."""
    out = maps(spark, d).where(F.col("map")[0][0].isNotNull()).select("vec_id", F.posexplode(explain.resize_image(F.col("map"), 10, 10)).alias("r", "row"))
    out = out.select("vec_id", F.col("r").cast("bigint").alias("r"), F.posexplode("row").alias("c", "v"))
    return rounded(out.withColumn("c", F.col("c").cast("bigint")), 5)


@query(MAP_SQL + "SELECT vec_id, c AS i, round(avg(v), 5) + 0.0 AS mean, round(max(v), 5) + 0.0 AS max FROM m WHERE v IS NOT NULL GROUP BY ALL")
def activation_condensed(spark, d):
    """Each map's importance by column, as a series is coloured with."""
    both = F.arrays_zip(explain.condense(F.col("map")).alias("mean"), explain.condense(F.col("map"), "max").alias("max"))
    out = maps(spark, d).where(F.col("map")[0][0].isNotNull()).select("vec_id", F.posexplode(both).alias("i", "z"))
    return rounded(out.select("vec_id", F.col("i").cast("bigint").alias("i"), "z.mean", "z.max"), 5)


def images(spark, d):
    rows = spectra_of(spark, d).withColumn("cls", F.concat(F.lit("class "), F.col("user_id") % 4))
    return spectra.image_table(rows, "user_id", "x", "cls", 4, 20, test_size=0.2, exclude=["class 2"])


@query(
    """WITH u AS (SELECT 'class ' || (user_id % 4) AS cls, count(DISTINCT user_id) AS n FROM events WHERE user_id % 4 <> 2 GROUP BY 1),
t AS (SELECT cls, n, ceil(n * 0.2)::BIGINT AS test, row_number() OVER (ORDER BY cls) - 1 AS code FROM u)
SELECT cls, code::INT AS code, 'test' AS split, test AS n FROM t UNION ALL SELECT cls, code::INT, 'train', n - test FROM t"""
)
def image_splits(spark, d):
    """Images by class and split: a fifth of each class is held out, one class is left out."""
    return images(spark, d).groupBy("cls", "code", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    V_SQL
    + """, y AS (SELECT user_id, i, ln(greatest(v / sum(v) OVER (PARTITION BY user_id), 1e-7)) AS v FROM v WHERE i BETWEEN 4 AND 19 AND user_id % 4 <> 2),
r AS (SELECT user_id, i, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM y WINDOW w AS (PARTITION BY user_id)),
a AS (SELECT user_id, i, least(1, greatest(-1, (2 * v - lo - hi) / (hi - lo))) AS c FROM r WHERE hi > lo)
SELECT user_id, count(*) ** 2 AS pixels, round(sum(c) ** 2 - sum(sqrt(1 - c * c)) ** 2, 3) + 0.0 AS total FROM a GROUP BY user_id"""
)
def image_sums(spark, d):
    """Number and sum of the pixels of each image, from the clipped, renormalised, logarithmic spectrum to the field."""
    flat = F.flatten("image")
    out = images(spark, d).where("image is not null").select("user_id", F.size(flat).cast("double").alias("pixels"), F.aggregate(flat, F.lit(0.0), lambda s, v: s + v).alias("total"))
    return rounded(out, 3)


# --- models -----------------------------------------------------------------------------------------------------


@query(
    "WITH k AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), "
    + ELLIPSE_SQL
    + """, i AS (SELECT l_returnflag = 'R' AS own, dist <= sqrt(-2 * ln(0.5)) AS inside FROM o),
r AS (SELECT avg(inside::INT) FILTER (own) AS tsns, 1 - avg(inside::INT) FILTER (NOT own) AS tsps, avg((inside = own)::INT) AS acc FROM i)
SELECT round(tsns, 6) AS tsns, round(tsps, 6) AS tsps, round(acc, 6) AS acc, round(sqrt(tsns * tsps), 6) AS teff, round(0 - (tsns - 0.5) ** 2, 6) + 0.0 AS score FROM r"""
)
def elliptic_authenticate(spark, d):
    """An ellipse of one class as its authenticator, scored rigorously."""
    df = lines(spark, d)
    auth = Authenticator(Ellipse(["l_quantity", "l_discount"], alpha=0.5), LABEL, "R", "rigorous")
    return rounded(auth.metrics(auth.fit(df), df), 6)


#: Principal axes of two columns in closed form.
TWO_SQL = """WITH x AS (SELECT l_quantity::DOUBLE AS x, 100 * l_tax AS y FROM lineitem),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM x),
e AS (SELECT *, 0.5 * atan2(2 * b, a - c) AS w, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS v1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS v2 FROM s)
"""


def two(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), (100 * F.col("l_tax")).alias("y"))


@query(
    TWO_SQL
    + """, t AS (SELECT (x - mx) * cos(w) + (y - my) * sin(w) AS t1, (y - my) * cos(w) - (x - mx) * sin(w) AS t2 FROM x, e), g AS (SELECT sign(arg_max(t1, abs(t1))) AS g1, sign(arg_max(t2, abs(t2))) AS g2 FROM t)
SELECT component, feature, round(loading, 5) + 0.0 AS loading, round(explained, 4) AS explained FROM (
SELECT 1 AS component, 'x' AS feature, g1 * cos(w) AS loading, v1 AS explained FROM e, g UNION ALL SELECT 1, 'y', g1 * sin(w), v1 FROM e, g
UNION ALL SELECT 2, 'x', -g2 * sin(w), v2 FROM e, g UNION ALL SELECT 2, 'y', g2 * cos(w), v2 FROM e, g)"""
)
def pca_loadings(spark, d):
    """Both components of two columns as a table; the row farthest along an axis is on its positive side."""
    df = two(spark, d)
    out = PCA(["x", "y"], 2).fit(df).loadings(spark)
    return out.select("component", "feature", (F.round("loading", 5) + 0.0).alias("loading"), F.round("explained", 4).alias("explained"))


@query(TWO_SQL + "SELECT round(sqrt(v1 * -2 * ln(0.05)), 4) AS first, round(sqrt(v2 * -2 * ln(0.05)), 4) AS second, round(sin(w) ** 2, 5) AS tilt FROM e")
def ellipse_shape(spark, d):
    """Half axes of the 95 % boundary of two columns, and the squared sine of the first one's angle."""
    (first, angle), (second, _) = Ellipse(["x", "y"]).fit(two(spark, d)).shape()
    return spark.createDataFrame([(round(first, 4), round(second, 4), round(math.sin(angle) ** 2, 5))], "first double, second double, tilt double")
