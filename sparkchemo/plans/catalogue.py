"""The registered queries over the driver's tables, each beside the SQL that checks it.

Doubles are rounded in both, because sums run in another order. ``QUERIES`` holds every
query; ``ORACLE`` the SQL of those that SQL can express.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkchemo.operators import clusters, comparison, explain, imputation, merit, openset, rebalance, screens, spectra
from sparkchemo.operators.moments import moments
from sparkchemo.operators.projection import PCA, PLSDA, SIMCA, Authenticator, Ellipse, LatentRegression, variable_importance
from sparkchemo.operators.scaling import CorrectedScaler, RobustScaler
from sparkchemo.plans import model_sql
from sparkchemo.sources.tables import batch_summary, keep_classes, pack_npy, table, unpack_npy

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ROW = ["l_orderkey", "l_linenumber"]
LABEL = "l_returnflag"
HOURS = 24

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles rounded, and minus zero made zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*ROW, *FEATURES, LABEL)


def spectra_of(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, x): the value of each hour of the day, summed; hours without events are 0."""
    hour = F.hour("ts")
    sums = [F.coalesce(F.sum(F.when(hour == h, F.col("value"))), F.lit(0.0)) for h in range(HOURS)]
    return table(spark, d, "events").groupBy("user_id").agg(F.array(*sums).alias("x"))


def points(df: DataFrame, x, key: str = "user_id") -> DataFrame:
    return rounded(df.select(key, F.posexplode(x).alias("i", "v")).withColumn("i", F.col("i").cast("bigint")))


def sql_columns(template: str, columns=FEATURES) -> str:
    return ", ".join(template.format(c=c) for c in columns)


V_SQL = """WITH h AS (SELECT unnest(range(0, 24)) AS i), u AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, hour(ts) AS i, sum(value) AS v FROM events GROUP BY ALL),
v AS (SELECT u.user_id, h.i, coalesce(e.v, 0.0) AS v FROM u CROSS JOIN h LEFT JOIN e ON e.user_id = u.user_id AND e.i = h.i)
"""


# --- column scalers ---------------------------------------------------------------------------------------------


@query(f"WITH s AS (SELECT {sql_columns('avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}')} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql_columns('round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}')} FROM lineitem, s")
def corrected_scaler(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(CorrectedScaler(FEATURES).fit(df).transform(df))


@query(f"WITH s AS (SELECT {sql_columns('avg({c}) AS m_{c}, sqrt(stddev_samp({c})) AS s_{c}')} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql_columns('round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}')} FROM lineitem, s")
def corrected_scaler_pareto(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(CorrectedScaler(FEATURES, pareto=True).fit(df).transform(df))


@query(f"WITH s AS (SELECT {sql_columns('avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}')} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql_columns('round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}')} FROM lineitem, s")
def corrected_scaler_biased(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(CorrectedScaler(FEATURES, biased=True).fit(df).transform(df))


@query(f"SELECT l_orderkey, l_linenumber, {sql_columns('round({c}, 4) + 0.0 AS {c}')} FROM lineitem")
def scaler_inverse(spark, d):
    df = lines(spark, d).drop(LABEL)
    model = CorrectedScaler(FEATURES).fit(df)
    return rounded(model.inverse_transform(model.transform(df)))


@query(f"WITH s AS (SELECT {sql_columns('avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}')} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql_columns('round({c} * s_{c} + m_{c}, 2) + 0.0 AS {c}')} FROM lineitem, s")
def scaler_inverse_raw(spark, d):
    """The inverse alone, of values that were never standardised."""
    df = lines(spark, d).drop(LABEL)
    return rounded(CorrectedScaler(FEATURES).fit(df).inverse_transform(df), 2)


def _robust_sql(low: float, high: float, root: str = "{w}") -> str:
    width = root.format(w=f"(quantile_cont({{c}}, {high}) - quantile_cont({{c}}, {low}))")
    return f"WITH s AS (SELECT {sql_columns(f'quantile_cont({{c}}, 0.5) AS m_{{c}}, {width} AS s_{{c}}')} FROM lineitem) SELECT l_orderkey, l_linenumber, {sql_columns('round(({c} - m_{c}) / s_{c}, 4) + 0.0 AS {c}')} FROM lineitem, s"


@query(_robust_sql(0.25, 0.75))
def robust_scaler(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(RobustScaler(FEATURES).fit(df).transform(df))


@query(_robust_sql(0.25, 0.75, "sqrt({w})"))
def robust_scaler_pareto(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(RobustScaler(FEATURES, pareto=True).fit(df).transform(df))


@query(_robust_sql(0.1, 0.9))
def robust_scaler_10_90(spark, d):
    df = lines(spark, d).drop(LABEL)
    return rounded(RobustScaler(FEATURES, rng=(10, 90)).fit(df).transform(df))


# --- row filters ------------------------------------------------------------------------------------------------


@query(V_SQL + "SELECT user_id, i, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 4) + 0.0 AS v FROM v WINDOW w AS (PARTITION BY user_id)")
def snv(spark, d):
    return points(spectra_of(spark, d), spectra.snv(F.col("x")))


@query(V_SQL + "SELECT user_id, i, round((v - quantile_cont(v, 0.51) OVER w) / (quantile_cont(v, 0.75) OVER w - quantile_cont(v, 0.25) OVER w), 4) + 0.0 AS v FROM v WINDOW w AS (PARTITION BY user_id)")
def rnv(spark, d):
    return points(spectra_of(spark, d), spectra.snv(F.col("x"), robust=True, q=51))


@query(
    V_SQL
    + """, s AS (SELECT user_id, i, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS v, 1 / sqrt(24.0) AS p0, (i - 11.5) / sqrt(1150.0) AS p1, (i - 11.5) * (i - 11.5) - 1150.0 / 24 AS q2 FROM v WINDOW w AS (PARTITION BY user_id)),
p AS (SELECT *, q2 / sqrt(sum(q2 * q2) OVER (PARTITION BY user_id)) AS p2 FROM s)
SELECT user_id, i, round(v - p0 * sum(v * p0) OVER w - p1 * sum(v * p1) OVER w - p2 * sum(v * p2) OVER w, 4) + 0.0 AS v FROM p WINDOW w AS (PARTITION BY user_id)"""
)
def snv_detrend(spark, d):
    return points(spectra_of(spark, d), spectra.snv(F.col("x"), detrend=True, length=HOURS))


@query(V_SQL + ", r AS (SELECT i, avg(v) AS r FROM v GROUP BY i), m AS (SELECT user_id, regr_slope(v, r) AS b, regr_intercept(v, r) AS a FROM v JOIN r USING (i) GROUP BY user_id) SELECT user_id, i, round((v - a) / b, 4) + 0.0 AS v FROM v JOIN m USING (user_id)")
def msc(spark, d):
    v = spectra_of(spark, d)
    return points(v, spectra.fit_msc(v, "x").transform(F.col("x")))


@query(V_SQL + ", m AS (SELECT user_id, regr_slope(v, i + 1) AS b, regr_intercept(v, i + 1) AS a FROM v GROUP BY user_id) SELECT user_id, i, round((v - a) / nullif(b, 0), 3) + 0.0 AS v FROM v JOIN m USING (user_id)")
def msc_xref(spark, d):
    v = spectra_of(spark, d)
    model = spectra.fit_msc(v, "x", [float(k) for k in range(1, HOURS + 1)])
    return rounded(v.select("user_id", F.posexplode(model.transform(F.col("x"))).alias("i", "v")).withColumn("i", F.col("i").cast("bigint")), 3)


@query(V_SQL + "SELECT * FROM (SELECT user_id, i, round((-3 * lag(v, 2) OVER w + 12 * lag(v, 1) OVER w + 17 * v + 12 * lead(v, 1) OVER w - 3 * lead(v, 2) OVER w) / 35, 4) + 0.0 AS v FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i)) WHERE i BETWEEN 2 AND 21")
def savgol_interior(spark, d):
    return points(spectra_of(spark, d), spectra.savgol(F.col("x"), HOURS, 5, 2)).where("i between 2 and 21")


def _derivative_sql(window: int = 7, order: int = 3) -> str:
    """Derivatives of the cubics fitted to unit impulses: the weight of place j in the result at place i."""
    rows = []
    for i in range(HOURS):
        start = min(max(i - window // 2, 0), HOURS - window)
        at = np.arange(start, start + window)
        for j in at.tolist():
            fit = np.polynomial.Polynomial.fit(at, (at == j).astype(float), order)
            rows.append(f"({i}, {j}, {float(fit.deriv()(i))!r})")
    return V_SQL + f", w(i, j, w) AS (VALUES {', '.join(rows)}) SELECT user_id, w.i::BIGINT AS i, round(sum(v * w), 4) + 0.0 AS v FROM v JOIN w ON w.j = v.i GROUP BY user_id, w.i"


@query(_derivative_sql())
def savgol_derivative(spark, d):
    return points(spectra_of(spark, d), spectra.savgol(F.col("x"), HOURS, 7, 3, deriv=1))


@query(V_SQL + "SELECT user_id, i - 4 AS i, round(ln(greatest(v / sum(v) OVER (PARTITION BY user_id), 1e-7)), 4) + 0.0 AS v FROM v WHERE i BETWEEN 4 AND 19")
def axis_clip_renorm_log(spark, d):
    return points(spectra_of(spark, d), spectra.clip_renormalise_log(F.col("x"), 4, 20))


FIELD_SQL = V_SQL + """, r AS (SELECT user_id, i, min(v) OVER w AS lo, max(v) OVER w AS hi, v FROM v WINDOW w AS (PARTITION BY user_id)),
a AS (SELECT user_id, i, least(1, greatest(-1, (2 * v - lo - hi) / (hi - lo))) AS c FROM r WHERE hi > lo)
"""


def field(spark, d, difference: bool) -> DataFrame:
    rows = spectra_of(spark, d).select("user_id", F.posexplode(spectra.gramian_field(F.col("x"), difference)).alias("i", "row"))
    flat = rows.select("user_id", F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "v"))
    return rounded(flat.withColumn("j", F.col("j").cast("bigint")), 5)


@query(FIELD_SQL + "SELECT a.user_id, a.i, b.i AS j, round(a.c * b.c - sqrt(1 - a.c * a.c) * sqrt(1 - b.c * b.c), 5) + 0.0 AS v FROM a JOIN a b ON a.user_id = b.user_id")
def gramian_sum(spark, d):
    return field(spark, d, False)


@query(FIELD_SQL + "SELECT a.user_id, a.i, b.i AS j, round(sqrt(1 - a.c * a.c) * b.c - a.c * sqrt(1 - b.c * b.c), 5) + 0.0 AS v FROM a JOIN a b ON a.user_id = b.user_id")
def gramian_difference(spark, d):
    return field(spark, d, True)


# --- imputation -------------------------------------------------------------------------------------------------


def with_gaps(spark, d) -> DataFrame:
    """The lines with l_tax missing in every third line of an order and l_discount in every fifth."""
    df = lines(spark, d)
    return df.withColumns({"l_tax": F.when(F.col("l_linenumber") != 3, F.col("l_tax")), "l_discount": F.when(F.col("l_linenumber") != 5, F.col("l_discount"))})


@query("SELECT l_linenumber::BIGINT AS l_linenumber, count(*) AS n, count(*) FILTER (l_discount < 0.03 OR l_linenumber = 5) AS low_discount, count(*) FILTER (l_tax < 0.02 OR l_linenumber = 3) AS low_tax, true AS in_bounds FROM lineitem GROUP BY l_linenumber")
def lod_impute(spark, d):
    limits = {"l_discount": 0.03, "l_tax": 0.02}
    gaps = with_gaps(spark, d).withColumns({f"was_{c}": F.col(c) for c in limits})
    made = imputation.below_limit(gaps, limits, [*ROW, "l_quantity", "l_extendedprice"])
    low = {c: F.col(f"was_{c}").isNull() | (F.col(f"was_{c}") < v) for c, v in limits.items()}
    fine = F.lit(True)
    for c, v in limits.items():
        fine = fine & F.when(low[c], (F.col(c) >= 0) & (F.col(c) < v)).otherwise(F.col(c) == F.col(f"was_{c}"))
    return made.groupBy(F.col("l_linenumber").cast("bigint").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low["l_discount"]).alias("low_discount"), F.count_if(low["l_tax"]).alias("low_tax"), F.bool_and(fine).alias("in_bounds")
    )


@query("WITH g AS (SELECT *, CASE WHEN l_linenumber <> 3 THEN l_tax END AS t, CASE WHEN l_linenumber <> 5 THEN l_discount END AS c FROM lineitem), m AS (SELECT avg(t) AS mt, avg(c) AS mc FROM g) SELECT l_orderkey, l_linenumber, round(coalesce(c, mc), 6) AS l_discount, round(coalesce(t, mt), 6) AS l_tax FROM g, m")
def mean_impute(spark, d):
    return rounded(imputation.fill_means(with_gaps(spark, d), ["l_discount", "l_tax"]).select(*ROW, "l_discount", "l_tax"), 6)


@query()
def pca_impute(spark, d):
    gaps = with_gaps(spark, d)
    return imputation.LowRankImputer(FEATURES, n_components=1, tol=1e-4).fit(gaps).transform(gaps)


@query()
def pls_impute(spark, d):
    gaps = with_gaps(spark, d)
    columns = ["l_quantity", "l_discount", "l_tax"]
    return imputation.LowRankImputer(columns, y="l_extendedprice", n_components=1, tol=1e-4).fit(gaps).transform(gaps)


# --- screens ----------------------------------------------------------------------------------------------------


def _flags_sql() -> str:
    out = []
    for c in FEATURES:
        out.append(f"SELECT 'nan' AS \"check\", NULL::VARCHAR AS cls, '{c}' AS feature, coalesce(bool_or({c} IS NULL OR isnan({c})), false) AS found FROM lineitem")
        out.append(f"SELECT 'inf', NULL, '{c}', coalesce(bool_or(isinf({c})), false) FROM lineitem")
        out.append(f"SELECT 'zero_variance', NULL, '{c}', stddev_pop({c}) < 1e-12 FROM lineitem")
        out.append(f"SELECT 'min_distinct', l_returnflag, '{c}', count(DISTINCT {c}) < 5 FROM lineitem GROUP BY l_returnflag")
        out.append(f"SELECT 'zero_class_variance', l_returnflag, '{c}', stddev_pop({c}) < 1e-12 FROM lineitem GROUP BY l_returnflag")
    out.append("SELECT 'min_obs', l_returnflag, NULL, count(*) < 5 FROM lineitem GROUP BY l_returnflag")
    out.append(f"SELECT 'duplicates', NULL, NULL, max(n) > 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(FEATURES)})")
    return " UNION ALL ".join(out)


@query(_flags_sql())
def red_flags(spark, d):
    return screens.red_flags(lines(spark, d), FEATURES, LABEL)


SPAN_SQL = "SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature"


def _js_sql(members: str, final: str, eps: str = "1e-12", span: str = SPAN_SQL) -> str:
    long = " UNION ALL ".join(f"SELECT l_returnflag AS cls, '{c}' AS feature, {c} AS x FROM lineitem" for c in FEATURES)
    return f"""WITH l AS ({long}), r AS ({span}),
b AS (SELECT feature, cls, least(24, floor((x - lo) / (hi - lo) * 25))::INT AS bin, count(*) AS n FROM l JOIN r USING (feature) WHERE x BETWEEN lo AND hi GROUP BY ALL),
mem AS ({members}), g AS (SELECT DISTINCT grp FROM mem),
grid AS (SELECT DISTINCT feature, grp, bin FROM r CROSS JOIN g CROSS JOIN (SELECT unnest(range(0, 25)) AS bin)),
sides AS (SELECT grid.feature, grid.grp, grid.bin, coalesce(sum(n) FILTER (mem.cls IS NOT NULL), 0) AS a, coalesce(sum(n) FILTER (mem.cls IS NULL), 0) AS z
  FROM grid LEFT JOIN b ON b.feature = grid.feature AND b.bin = grid.bin LEFT JOIN mem ON mem.grp = grid.grp AND mem.cls = b.cls GROUP BY ALL),
p AS (SELECT *, (a + {eps}) / sum(a) OVER w AS p, (z + {eps}) / sum(z) OVER w AS q FROM sides WINDOW w AS (PARTITION BY feature, grp)),
m AS (SELECT *, (p + q) / 2 AS m FROM p), s AS (SELECT *, sum(p) OVER w AS sp, sum(q) OVER w AS sq, sum(m) OVER w AS sm FROM m WINDOW w AS (PARTITION BY feature, grp)),
j AS (SELECT feature, grp, 0.5 * sum(p / sp * log2((p / sp) / (m / sm))) + 0.5 * sum(q / sq * log2((q / sq) / (m / sm))) AS jsd FROM s GROUP BY feature, grp)
{final}"""


ONE_SQL = "SELECT DISTINCT l_returnflag AS grp, l_returnflag AS cls FROM lineitem"
TWO_SQL = ONE_SQL + " UNION ALL SELECT a.f || ' AND ' || b.f, c.f FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem) a JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) b ON a.f < b.f JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) c ON c.f IN (a.f, b.f)"


@query(_js_sql(ONE_SQL, "SELECT feature, grp AS cls, round(jsd, 7) + 0.0 AS jsd FROM j"))
def js_per_class(spark, d):
    return rounded(screens.js_per_class(lines(spark, d), FEATURES, LABEL), 7)


@query(_js_sql(ONE_SQL, "SELECT DISTINCT feature FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY jsd DESC, feature) AS k FROM j) WHERE k <= 2 AND jsd > 0"))
def js_topk(spark, d):
    return screens.js_select(screens.js_per_class(lines(spark, d), FEATURES, LABEL), top=2)


@query(_js_sql(ONE_SQL, "SELECT feature FROM (SELECT feature, avg(jsd) AS v FROM j GROUP BY feature) WHERE v > 0 ORDER BY v DESC, feature LIMIT 1"))
def js_overall(spark, d):
    return screens.js_select(screens.js_per_class(lines(spark, d), FEATURES, LABEL), top=1, by_class=False)


#: The quartiles' fences by the midpoint rule, inside the least and greatest value.
FENCE_SQL = """SELECT feature, greatest(a - 1.5 * (b - a), lo) AS lo, least(b + 1.5 * (b - a), hi) AS hi FROM (
SELECT feature, min(x) AS lo, max(x) AS hi, avg(x) FILTER (k IN (floor((n - 1) * 0.25), ceil((n - 1) * 0.25))) AS a, avg(x) FILTER (k IN (floor((n - 1) * 0.75), ceil((n - 1) * 0.75))) AS b
FROM (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM l) GROUP BY feature)"""


@query(_js_sql(ONE_SQL, "SELECT feature, grp AS cls, round(jsd, 7) + 0.0 AS jsd FROM j", span=FENCE_SQL))
def js_robust(spark, d):
    return rounded(screens.js_per_class(lines(spark, d), FEATURES, LABEL, robust=True), 7)


@query(_js_sql(TWO_SQL, "SELECT feature, grp, round(jsd, 7) + 0.0 AS jsd FROM j"))
def js_screen(spark, d):
    return rounded(screens.js_screen(lines(spark, d), FEATURES, LABEL, 2), 7)


STEPS_SQL = """, best AS (SELECT grp, max(jsd) AS final FROM j GROUP BY grp), st AS (
SELECT b.grp, m.cls, b.final - o.final AS delta, b.final, a.final AS alone FROM best b JOIN mem m USING (grp) JOIN mem om ON om.grp = b.grp AND om.cls <> m.cls
JOIN best o ON o.grp = om.cls JOIN best a ON a.grp = m.cls) """


@query(_js_sql(TWO_SQL, STEPS_SQL + "SELECT grp, cls, round(delta, 7) + 0.0 AS delta, round(final, 7) + 0.0 AS final, round(alone, 7) + 0.0 AS alone FROM st"))
def js_incremental(spark, d):
    return rounded(screens.js_incremental(screens.js_screen(lines(spark, d), FEATURES, LABEL, 2)), 7)


@query(_js_sql(TWO_SQL, STEPS_SQL + "SELECT grp, round(max(final), 7) + 0.0 AS final FROM st GROUP BY grp HAVING bool_or(final > 1e-6 AND final - delta < 1e-6 AND delta > 0) AND max(alone) < max(final)"))
def js_interesting(spark, d):
    return rounded(screens.js_interesting(screens.js_incremental(screens.js_screen(lines(spark, d), FEATURES, LABEL, 2)), threshold=1e-6), 7)


#: Two halves of the quantities, each dealt to two classes: only together are these told apart.
HALVES_SQL = "((CASE WHEN l_quantity <= 25 THEN 'low' ELSE 'high' END) || (l_linenumber % 2))"


def halves(spark, d) -> DataFrame:
    return lines(spark, d).withColumn(LABEL, F.concat(F.when(F.col("l_quantity") <= 25, "low").otherwise("high"), (F.col("l_linenumber") % 2).cast("string")))


@query(_js_sql(TWO_SQL, STEPS_SQL + "SELECT grp, round(max(final), 7) + 0.0 AS final FROM st GROUP BY grp HAVING bool_or(final > 0.7 AND final - delta < 0.7 AND delta > 0) AND max(alone) < max(final)").replace("l_returnflag", HALVES_SQL))
def js_interesting_halves(spark, d):
    return rounded(screens.js_interesting(screens.js_incremental(screens.js_screen(halves(spark, d), FEATURES, LABEL, 2))), 7)


@query(_js_sql(TWO_SQL, "SELECT grp, round(max(jsd), 7) + 0.0 AS best, round(stddev_pop(jsd), 7) + 0.0 AS deviation FROM j GROUP BY grp").replace("l_returnflag", HALVES_SQL))
def js_group_table(spark, d):
    return rounded(screens.group_table(screens.js_screen(halves(spark, d), FEATURES, LABEL, 2)), 7)


@query(
    _js_sql(ONE_SQL, ", top AS (SELECT grp, arg_max(feature, jsd) AS feature FROM j GROUP BY grp) SELECT top.grp, top.feature, b.bin, b.cls = top.grp AS inside, sum(b.n)::BIGINT AS n FROM top JOIN b ON b.feature = top.feature GROUP BY ALL").replace("l_returnflag", HALVES_SQL)
)
def js_best_histograms(spark, d):
    df = halves(spark, d)
    return screens.best_feature_histograms(df, FEATURES, LABEL, screens.js_screen(df, FEATURES, LABEL, 1))


@query("WITH c AS (SELECT c_acctbal, c_nationkey, min(c_custkey) AS k FROM customer GROUP BY ALL) SELECT x.k AS a, y.k AS b FROM c x JOIN c y ON x.k < y.k AND sqrt((x.c_acctbal - y.c_acctbal) ** 2 + (x.c_nationkey - y.c_nationkey) ** 2) < 2.5")
def close_customers(spark, d):
    return screens.close_pairs(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey", 2.5)


@query(
    f"""WITH l AS ({" UNION ALL ".join(f"SELECT l_returnflag AS cls, '{c}' AS feature, {c} AS x FROM lineitem" for c in FEATURES)}), r AS (SELECT feature, cls, min(x) AS lo, max(x) AS hi FROM l GROUP BY ALL),
pr AS (SELECT s.feature, s.cls AS a, t.cls AS b, least(s.lo, t.lo) AS lo, greatest(s.hi, t.hi) AS hi FROM r s JOIN r t ON s.feature = t.feature AND s.cls < t.cls),
n AS (SELECT a, b, pr.feature, least(24, floor((x - lo) / (hi - lo) * 25))::INT AS bin, count(*) FILTER (cls = a) AS na, count(*) FILTER (cls = b) AS nb FROM pr JOIN l ON l.feature = pr.feature AND cls IN (a, b) GROUP BY ALL),
g AS (SELECT a, b, feature, bin, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT a, b, feature, unnest(range(0, 25))::INT AS bin FROM pr) LEFT JOIN n USING (a, b, feature, bin)),
p AS (SELECT *, (na + 1e-12) / sum(na) OVER w AS p, (nb + 1e-12) / sum(nb) OVER w AS q FROM g WINDOW w AS (PARTITION BY a, b, feature)),
s AS (SELECT *, (p + q) / 2 AS m, sum(p) OVER w AS sp, sum(q) OVER w AS sq, sum((p + q) / 2) OVER w AS sm FROM p WINDOW w AS (PARTITION BY a, b, feature)),
j AS (SELECT a, b, feature, 0.5 * sum(p / sp * log2((p / sp) / (m / sm))) + 0.5 * sum(q / sq * log2((q / sq) / (m / sm))) AS jsd FROM s GROUP BY ALL)
SELECT a, b, arg_max(feature, jsd) AS feature, round(max(jsd), 7) + 0.0 AS jsd FROM j GROUP BY a, b"""
)
def js_pairs(spark, d):
    return rounded(screens.js_pairs(lines(spark, d), FEATURES, LABEL), 7)


@query(
    f"WITH k AS (SELECT {sql_columns('rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}')} FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS rho FROM k" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])
)
def spearman_matrix(spark, d):
    return rounded(screens.spearman(lines(spark, d), FEATURES), 6)


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(FEATURES)} FROM lineitem")
def collinear_select_cut(spark, d):
    """A column that rises with another goes; at this cut nothing else belongs together."""
    df = lines(spark, d).withColumn("squared", F.col("l_quantity") * F.col("l_quantity"))
    return df.select(*ROW, *screens.select_collinear(df, [*FEATURES, "squared"], cut=0.5))


@query()
def collinear_select(spark, d):
    df = lines(spark, d)
    return df.select(*ROW, *screens.select_collinear(df, FEATURES))


# --- labels, batches, filters -----------------------------------------------------------------------------------


@query("SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'A AND R' ELSE l_returnflag END AS cls, count(*) AS n FROM lineitem GROUP BY 1")
def macroclass_relabel(spark, d):
    return screens.relabel(lines(spark, d), LABEL, ["A AND R"]).groupBy(F.col(LABEL).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, round(sum(count(*)) OVER () / (count(*) * count(*) OVER ()), 6) AS weight FROM lineitem GROUP BY l_returnflag")
def class_weights(spark, d):
    return rounded(explain.class_weights(lines(spark, d), LABEL), 6)


@query("SELECT l_returnflag, (dense_rank() OVER (ORDER BY l_returnflag) - 1)::BIGINT AS code, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def label_encode(spark, d):
    return explain.encode_labels(lines(spark, d), LABEL).groupBy(LABEL, F.col("code").cast("bigint").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id // 32 AS batch, count(*) AS n, count(DISTINCT label) AS classes FROM embeddings GROUP BY 1")
def batches(spark, d):
    return batch_summary(table(spark, d, "embeddings"), "label", 32, "vec_id")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_returnflag <> 'R'")
def include_exclude(spark, d):
    return keep_classes(lines(spark, d), LABEL, ["A", "R"], ["R"]).select(*ROW, LABEL)


@query("SELECT vec_id, len(embedding)::BIGINT AS n, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) + 0.0 AS total FROM embeddings")
def npy_round_trip(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").alias("data"))
    back = unpack_npy(pack_npy(e))
    return rounded(back.select(F.col("path").cast("bigint").alias("vec_id"), F.size("data").cast("bigint").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total")))


def _covariance_sql(n: int = 64) -> str:
    return f"""WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT a.i AS a, b.i AS b, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i AND b.i < {n} GROUP BY a.i, b.i"""


@query(_covariance_sql())
def wide_covariances(spark, d):
    names = [f"e{i}" for i in range(64)]
    c = moments(table(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names).covariance
    return rounded(spark.createDataFrame([(i, j, float(c[i, j])) for i in range(64) for j in range(i, 64)], "a bigint, b bigint, cov double"), 6)


# --- projection models ------------------------------------------------------------------------------------------

TWO = ["l_quantity", "l_extendedprice"]
PCA2_SQL = """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2, corr(l_quantity, l_extendedprice) AS r FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, (l_quantity - m1) / s1 AS z1, (l_extendedprice - m2) / s2 AS z2, r FROM lineitem, s),
t AS (SELECT *, (z1 + sign(r) * z2) / sqrt(2.0) AS t1, (z1 - sign(r) * z2) / sqrt(2.0) AS t2 FROM z),
hq AS (SELECT *, t1 * t1 / (1 + abs(r)) AS h, t2 * t2 AS q FROM t),
dof AS (SELECT avg(h) AS h0, greatest(round(2 * avg(h) ** 2 / var_samp(h)), 1) AS nh, avg(q) AS q0, greatest(round(2 * avg(q) ** 2 / var_samp(q)), 1) AS nq FROM hq)
"""


@query(PCA2_SQL + "SELECT l_orderkey, l_linenumber, round(t1 * (SELECT sign(arg_max(t1, abs(t1))) FROM t), 4) + 0.0 AS pc1 FROM t")
def pca2_scores(spark, d):
    df = lines(spark, d)
    return rounded(PCA(TWO, 1, scale=True, robust="classical").fit(df).transform(df).select(*ROW, "pc1"))


@query(PCA2_SQL + "SELECT l_orderkey, l_linenumber, round(h, 4) + 0.0 AS h, round(q, 4) + 0.0 AS q, round(nh * h / h0 + nq * q / q0, 4) + 0.0 AS distance FROM hq, dof")
def pca2_distance_classical(spark, d):
    df = lines(spark, d)
    return rounded(PCA(TWO, 1, scale=True, robust="classical").fit(df).score(df).select(*ROW, "h", "q", "distance"))


ALL, RETURNED = "SELECT * FROM lineitem", "SELECT * FROM lineitem WHERE l_returnflag = 'R'"


@query(
    model_sql.pca(ALL, ALL, FEATURES, 2, cuts=model_sql.LIMITS)
    + f"SELECT s.n, nh::BIGINT AS nh, round(h0, 4) + 0.0 AS h0, nq::BIGINT AS nq, round(q0, 4) + 0.0 AS q0, round({model_sql.CRIT}, 4) AS c_crit, round({model_sql.OUT}, 4) AS c_out FROM s, d"
)
def pca_limits(spark, d):
    df = lines(spark, d)
    m = PCA(FEATURES, 2, scale=True).fit(df)
    return rounded(spark.createDataFrame([(m.n, m.dof_h[0], m.dof_h[1], m.dof_q[0], m.dof_q[1], m.c_crit, m.c_out)], "n bigint, nh bigint, h0 double, nq bigint, q0 double, c_crit double, c_out double"))


@query(
    model_sql.pca(RETURNED, ALL, FEATURES, 2, [LABEL], cuts=model_sql.LIMITS)
    + f""", r AS (SELECT avg((distance < {model_sql.CRIT})::INT) FILTER (l_returnflag = 'R') AS tsns, 1 - avg((distance < {model_sql.CRIT})::INT) FILTER (l_returnflag <> 'R') AS tsps,
avg(((distance < {model_sql.CRIT}) = (l_returnflag = 'R'))::INT) AS acc FROM f)
SELECT round(tsns, 6) AS tsns, round(tsps, 6) AS tsps, round(acc, 6) AS acc, round(sqrt(tsns * tsps), 6) AS teff, round(sqrt(tsns * tsps), 6) AS score FROM r"""
)
def ddsimca_authenticate(spark, d):
    df = lines(spark, d)
    auth = Authenticator(PCA(FEATURES, 2, scale=True, capped=True, gamma=0.01), LABEL, "R", "compliant")
    return rounded(auth.metrics(auth.fit(df), df), 6)


@query(
    model_sql.pca(RETURNED, ALL, FEATURES, 2, [*ROW, LABEL], cuts=model_sql.LIMITS)
    + f"""SELECT l_orderkey, l_linenumber, l_returnflag, round(distance, 4) + 0.0 AS distance, distance < {model_sql.CRIT} AS inlier,
distance >= {model_sql.CRIT} AND distance < {model_sql.OUT} AS extreme, distance >= {model_sql.OUT} AS outlier FROM f"""
)
def ddsimca_predict(spark, d):
    df = lines(spark, d)
    return rounded(PCA(FEATURES, 2, scale=True, capped=True).fit(df.where(F.col(LABEL) == "R")).score(df).select(*ROW, LABEL, "distance", "inlier", "extreme", "outlier"))


PROBABLE_SQL = "1 / (1 + exp(-({crit} - {dist})))"


def _loss_sql(probability: str, inlier: str, truth: str) -> str:
    p = f"least(greatest({probability}, 1e-15), 1 - 1e-15)"
    return f"SELECT round(avg(-ln(CASE WHEN {truth} THEN {p} ELSE 1 - {p} END)), 6) AS loss, round(avg((({inlier}) = ({truth}))::INT), 6) AS accuracy"


@query(
    model_sql.pca(RETURNED, ALL, FEATURES, 2, [LABEL], cuts=model_sql.LIMITS)
    + _loss_sql(PROBABLE_SQL.format(crit=f"sqrt({model_sql.CRIT})", dist="sqrt(distance)"), f"distance < {model_sql.CRIT}", "l_returnflag = 'R'")
    + " FROM f"
)
def ddsimca_loss(spark, d):
    df = lines(spark, d)
    return rounded(PCA(FEATURES, 2, scale=True, capped=True).fit(df.where(F.col(LABEL) == "R")).loss(df.withColumn("truth", F.col(LABEL) == "R"), "truth"), 6)


@query(
    model_sql.pca(ALL, ALL, FEATURES, 2, cuts=model_sql.LIMITS)
    + ", cd AS (SELECT greatest(round(2 * avg(h) ** 2 / var_samp(h)), 1) AS nh, avg(h) AS h0, greatest(round(2 * avg(q) ** 2 / var_samp(q)), 1) AS nq, avg(q) AS q0 FROM ht), "
    + model_sql.chi2("y", f"SELECT v.id, v.p, nh + nq AS n FROM (SELECT v.id, v.p FROM s, LATERAL (VALUES {model_sql.LIMITS}) AS v(id, p)) v, cd")
    + f""", o AS (SELECT nh * h / h0 + nq * q / q0 AS c FROM ht, cd)
SELECT c < (SELECT x FROM y WHERE id = 0) AS inlier, c >= (SELECT x FROM y WHERE id = 1) AS outlier, count(*) AS n FROM o
WHERE NOT EXISTS (SELECT 1 FROM f WHERE distance >= {model_sql.OUT}) GROUP BY ALL"""
)
def ddsimca_clean(spark, d):
    """No line is an outlier of the first fit (the SQL gives nothing otherwise), so cleaning ends with its classical fit."""
    df = lines(spark, d)
    m = PCA(FEATURES, 2, scale=True, capped=True, clean=True).fit(df)
    return m.score(df).groupBy("inlier", "outlier").agg(F.count(F.lit(1)).alias("n"))


SIMCA_TABLE = "SELECT l_orderkey, l_linenumber, round(distance, 4) + 0.0 AS distance, distance < f AS inlier FROM r"


def _simca_sql(keys: list[str], rest: str) -> str:
    """Four columns and two axes leave two degrees above, where the F law has a closed form; ``rest`` reads ``r`` (keys, distance, f)."""
    left = lambda i: f"z{i} - " + " - ".join(f"({model_sql.cell('p1', i, j)} + {model_sql.cell('p2', i, j)}) * z{j}" for j in range(4))
    q = " + ".join(f"s.s{i} * s.s{i} * pow({left(i)}, 2)" for i in range(4))
    parts = [model_sql.standardised("SELECT * FROM lineitem WHERE l_returnflag = 'N'", ALL, FEATURES, keys, True), model_sql.axes(4, 2)]
    parts += [f"t AS (SELECT sum({q}) AS total FROM zt, e, s)", f"r AS (SELECT {', '.join(keys)}, ({q}) / 2 / (total / (2 * (s.n - 3))) AS distance, (s.n - 3) * (pow(0.05, -1.0 / (s.n - 3)) - 1) AS f FROM z, e, s, t)"]
    return "WITH RECURSIVE " + ", ".join(parts) + " " + rest


@query(_simca_sql(ROW, SIMCA_TABLE))
def simca_distance(spark, d):
    df = lines(spark, d)
    return rounded(SIMCA(FEATURES, 2).fit(df.where(F.col(LABEL) == "N")).score(df).select(*ROW, "distance", "inlier"))


@query(_simca_sql([LABEL], _loss_sql(PROBABLE_SQL.format(crit="sqrt(f)", dist="sqrt(distance)"), "distance < f", "l_returnflag = 'N'") + " FROM r"))
def simca_loss(spark, d):
    """Log loss and accuracy of the decision, by the probabilities of its margin."""
    df = lines(spark, d)
    return rounded(SIMCA(FEATURES, 2).fit(df.where(F.col(LABEL) == "N")).loss(df.withColumn("truth", F.col(LABEL) == "N"), "truth"), 6)


E8 = [f"e{i}" for i in range(8)]


def vectors(n: int) -> str:
    return "SELECT vec_id, label::VARCHAR AS label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(n)) + " FROM embeddings"


@query(
    model_sql.pca(vectors(8), vectors(8), E8, 3, scale=False, cuts="(0, 0.95)")
    + ", "
    + model_sql.chi2("cut", "SELECT i AS id, 1 - i::DOUBLE / s.n AS p, nh + nq AS n FROM s, d, LATERAL (SELECT unnest(range(1, s.n // 4 + 1)) AS i)")
    + """SELECT id::INT AS expected, count(*) FILTER (distance >= x) AS observed, round(id - 2 * sqrt(id * (1 - id::DOUBLE / s.n)), 4) + 0.0 AS low, round(id + 2 * sqrt(id * (1 - id::DOUBLE / s.n)), 4) + 0.0 AS high
FROM cut, f, s GROUP BY id, x, s.n"""
)
def extremes_curve(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    return rounded(PCA(E8, 3).fit(e).extremes(e))


ELLIPSE_SQL = """s AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS c FROM k),
o AS (SELECT l.*, sqrt(((l_quantity - m1) ** 2 * c - 2 * (l_quantity - m1) * (l_discount - m2) * b + (l_discount - m2) ** 2 * a) / (a * c - b * b)) AS dist FROM lineitem l, s)"""


@query("WITH k AS (SELECT * FROM lineitem), " + ELLIPSE_SQL + " SELECT l_orderkey, l_linenumber, round(dist, 4) + 0.0 AS distance, dist <= sqrt(-2 * ln(0.05)) AS inlier FROM o")
def elliptic2d_predict(spark, d):
    df = lines(spark, d)
    return rounded(Ellipse(["l_quantity", "l_discount"]).fit(df).score(df).select(*ROW, "distance", "inlier"))


def _robust_ellipse_sql(rounds: int = 10) -> str:
    """The concentration steps unrolled; one that no longer shrinks the determinant is the last that counts."""
    x, y = TWO
    dist = f"sqrt((pow({x} - m1, 2) * c - 2 * ({x} - m1) * ({y} - m2) * b + pow({y} - m2, 2) * a) / (a * c - b * b))"
    stats = f"var_samp({x}) AS a, covar_samp({x}, {y}) AS b, var_samp({y}) AS c"
    parts = [f"e0 AS (SELECT quantile_cont({x}, 0.5) AS m1, quantile_cont({y}, 0.5) AS m2, {stats}, 1e300::DOUBLE AS last, false AS done FROM lineitem)"]
    for k in range(1, rounds + 1):
        parts.append(f"d{k} AS (SELECT {x}, {y}, {dist} AS d FROM lineitem, e{k - 1})")
        parts.append(f"n{k} AS (SELECT avg({x}) AS m1, avg({y}) AS m2, {stats} FROM d{k} WHERE d <= (SELECT quantile_cont(d, 0.5) FROM d{k}))")
        new = ", ".join(f"CASE WHEN e.done THEN e.{v} ELSE n.{v} END AS {v}" for v in ("m1", "m2", "a", "b", "c"))
        parts.append(f"e{k} AS (SELECT {new}, n.a * n.c - n.b * n.b AS last, e.done OR n.a * n.c - n.b * n.b >= e.last * (1 - 1e-12) AS done FROM e{k - 1} AS e, n{k} AS n)")
    parts.append(f"o AS (SELECT {dist} AS d FROM lineitem, e{rounds}), z AS (SELECT quantile_cont(d, 0.5) / sqrt(2 * ln(2)) AS s FROM o)")
    return "WITH " + ", ".join(parts) + " SELECT d / s <= sqrt(-2 * ln(0.05)) AS inlier, count(*) AS n FROM o, z GROUP BY 1"


@query(
    "WITH k AS (SELECT * FROM lineitem WHERE l_returnflag = 'R'), "
    + ELLIPSE_SQL
    + _loss_sql(PROBABLE_SQL.format(crit="sqrt(-2 * ln(0.05))", dist="dist"), "dist <= sqrt(-2 * ln(0.05))", "l_returnflag = 'R'")
    + " FROM o"
)
def elliptic_loss(spark, d):
    df = lines(spark, d)
    return rounded(Ellipse(["l_quantity", "l_discount"]).fit(df.where(F.col(LABEL) == "R")).loss(df.withColumn("truth", F.col(LABEL) == "R"), "truth"), 6)


@query(
    """WITH s AS (SELECT count(*) AS n, avg(s_acctbal) AS m1, avg(s_nationkey) AS m2, var_samp(s_acctbal) AS a, covar_samp(s_acctbal, s_nationkey) AS b, var_samp(s_nationkey) AS c FROM supplier),
o AS (SELECT sqrt(((s_acctbal - m1) ** 2 * c - 2 * (s_acctbal - m1) * (s_nationkey - m2) * b + (s_nationkey - m2) ** 2 * a) / (a * c - b * b)) AS d FROM supplier, s),
k AS (SELECT unnest(range(1, n // 4 + 1)) AS k, n FROM s)
SELECT k::INT AS expected, (SELECT count(*) FROM o WHERE d > sqrt(-2 * ln(k / n::DOUBLE))) AS observed, round(k - 2 * sqrt(k * (1 - k / n::DOUBLE)), 4) + 0.0 AS low, round(k + 2 * sqrt(k * (1 - k / n::DOUBLE)), 4) + 0.0 AS high FROM k"""
)
def elliptic_extremes(spark, d):
    df = table(spark, d, "supplier")
    two = ["s_acctbal", "s_nationkey"]
    return rounded(Ellipse(two).fit(df).extremes(df, df.count()))


@query(_robust_ellipse_sql())
def elliptic_robust(spark, d):
    df = lines(spark, d)
    return Ellipse(TWO, robust=True).fit(df).score(df).groupBy("inlier").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT avg(l_extendedprice) AS y0, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_tax) AS m3, covar_samp(l_quantity, l_extendedprice) AS w1, covar_samp(l_discount, l_extendedprice) AS w2, covar_samp(l_tax, l_extendedprice) AS w3,
var_samp(l_quantity) AS a, var_samp(l_discount) AS b, var_samp(l_tax) AS c, covar_samp(l_quantity, l_discount) AS ab, covar_samp(l_quantity, l_tax) AS ac, covar_samp(l_discount, l_tax) AS bc FROM lineitem)
SELECT l_orderkey, l_linenumber, round(y0 + (w1 * w1 + w2 * w2 + w3 * w3) / (w1 * w1 * a + w2 * w2 * b + w3 * w3 * c + 2 * (w1 * w2 * ab + w1 * w3 * ac + w2 * w3 * bc)) * (w1 * (l_quantity - m1) + w2 * (l_discount - m2) + w3 * (l_tax - m3)), 2) + 0.0 AS predicted FROM lineitem, s"""
)
def pls1_predict(spark, d):
    df = lines(spark, d)
    m = LatentRegression(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1, robust=False).fit(df)
    return rounded(df.select(*ROW, m.predict().alias("predicted")), 2)


@query(
    """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_discount) AS m2, stddev_samp(l_discount) AS s2, corr(l_quantity, l_discount) AS r, avg(l_extendedprice) AS y0 FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, ((l_quantity - m1) / s1 + sign(r) * (l_discount - m2) / s2) / sqrt(2.0) AS t, y0 FROM lineitem, s), b AS (SELECT covar_samp(t, y) / var_samp(t) AS b FROM t)
SELECT l_orderkey, l_linenumber, round(y0 + b * t, 2) + 0.0 AS predicted FROM t, b"""
)
def pcr1_predict(spark, d):
    df = lines(spark, d)
    m = LatentRegression(["l_quantity", "l_discount"], "l_extendedprice", 1, "pcr", scale=True, robust=False).fit(df)
    return rounded(df.select(*ROW, m.predict().alias("predicted")), 2)


@query(
    model_sql.pls_limits(ALL, ALL, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2)
    + ", l AS (SELECT "
    + ", ".join(f"max(x) FILTER (id = {i}) AS l{i}" for i in range(4))
    + """ FROM x) SELECT f >= l0 AND f < l1 AS x_extreme, f >= l1 AS x_outlier, g >= l2 AND g < l3 AS xy_extreme, g >= l3 AS xy_outlier, count(*) AS n FROM f, l GROUP BY ALL"""
)
def pls_outliers(spark, d):
    df = lines(spark, d)
    m = LatentRegression(["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2, scale=True).fit(df)
    return m.score(df, "l_extendedprice").groupBy("x_extreme", "x_outlier", "xy_extreme", "xy_outlier").agg(F.count(F.lit(1)).alias("n"))


@query(model_sql.pls_importance(ALL, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2))
def pls_vip(spark, d):
    columns = ["l_quantity", "l_discount", "l_tax"]
    m = moments(lines(spark, d), [*columns, "l_extendedprice"])
    vip = variable_importance(m.products[:3, :3], m.products[:3, 3:], 2)
    return rounded(spark.createDataFrame([(c, float(v)) for c, v in zip(columns, vip, strict=True)], "feature string, vip double"), 6)


@query(
    model_sql.plsda(ALL, FEATURES, LABEL, ["A", "N", "R"], 2, ROW)
    + """SELECT l_orderkey, l_linenumber, l_returnflag, coalesce(list_aggregate(list_transform(list_sort(list_filter([{'d': d2_0, 'c': 'A'}, {'d': d2_1, 'c': 'N'}, {'d': d2_2, 'c': 'R'}], lambda x: x.d < -2 * ln(0.05))),
lambda x: x.c), 'string_agg', ','), 'NOT_ASSIGNED') AS predicted FROM d2"""
)
def plsda_soft(spark, d):
    df = lines(spark, d)
    return PLSDA(FEATURES, LABEL, 2).fit(df).score(df).select(*ROW, LABEL, F.array_join("predicted", ",").alias("predicted"))


@query()
def plsda_hard(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(16)])
    return PLSDA([f"e{i}" for i in range(16)], "label", 6, style="hard").fit(e).score(e).select("vec_id", "label", F.col("predicted")[0].alias("predicted"))


# --- open-set recognition ---------------------------------------------------------------------------------------


def logits():
    return F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double"))


E_SQL = "WITH x AS (SELECT vec_id, unnest(embedding[1:10])::DOUBLE AS v FROM embeddings), s AS (SELECT vec_id, max(v) AS m, max(v) + ln(sum(exp(v - (SELECT max(v) FROM x)))) + (SELECT max(v) FROM x) - max(v) AS lse FROM x GROUP BY vec_id) "


@query(E_SQL + "SELECT vec_id, round(exp(m - lse), 6) + 0.0 AS score FROM s")
def ood_softmax(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", openset.softmax_score(logits()).alias("score")), 6)


@query(E_SQL + "SELECT vec_id, round(lse, 6) + 0.0 AS score FROM s")
def ood_energy(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", openset.energy_score(logits()).alias("score")), 6)


@query(E_SQL + ", k AS (SELECT lse, row_number() OVER (ORDER BY lse) - 1 AS k, count(*) OVER () AS n FROM s) SELECT vec_id, lse >= (SELECT lse FROM k WHERE k = floor((n - 1) * 0.05)) AS inlier FROM s")
def ood_threshold(spark, d):
    e = table(spark, d, "embeddings")
    return openset.fit_threshold(e, lambda: openset.energy_score(logits())).predict(e).select("vec_id", "inlier")


def _dime_sql() -> str:
    """What is left of a row after its projection on four axes, and the lower 5 % rank of it."""
    off = "sqrt(greatest(0, " + " + ".join(f"z{i} * z{i}" for i in range(16)) + " - " + " - ".join(model_sql.quadratic(f"p{c}", 16) for c in range(1, 5)) + "))"
    parts = [model_sql.standardised(vectors(16), vectors(16), [f"e{i}" for i in range(16)], ["vec_id"], False), model_sql.axes(16, 4), f"o AS (SELECT vec_id, -{off} AS v FROM z, e)"]
    parts.append("r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM o)")
    return "WITH RECURSIVE " + ", ".join(parts) + " SELECT vec_id, round(v, 6) + 0.0 AS ood_score, v >= (SELECT v FROM r WHERE i = floor((n - 1) * 0.05)) AS inlier FROM o"


@query(_dime_sql())
def ood_dime(spark, d):
    columns = [f"e{i}" for i in range(16)]
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(16)])
    return rounded(openset.fit_threshold(e, openset.dime_score(e, columns, 4)).predict(e).select("vec_id", "ood_score", "inlier"), 6)


@query(
    "WITH k AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R')), "
    + ELLIPSE_SQL
    + """, i AS (SELECT * FROM o WHERE dist <= sqrt(-2 * ln(0.05)) AND l_returnflag IN ('A', 'R')), sd AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_discount) AS e FROM i),
ce AS (SELECT l_returnflag AS f, avg(l_quantity) AS cq, avg(l_discount) AS ce FROM i GROUP BY 1),
v AS (SELECT o.l_returnflag, dist, max(((l_quantity - cq) / q) ** 2 + ((l_discount - ce) / e) ** 2) FILTER (f = 'A') AS da, max(((l_quantity - cq) / q) ** 2 + ((l_discount - ce) / e) ** 2) FILTER (f = 'R') AS dr
  FROM o, sd, ce GROUP BY o.rowid_, o.l_returnflag, dist)
SELECT l_returnflag, CASE WHEN dist > sqrt(-2 * ln(0.05)) THEN 'Unknown' WHEN da <= dr THEN 'A' ELSE 'R' END AS predicted, count(*) AS n FROM v GROUP BY ALL""".replace("o.rowid_", "o.l_orderkey, o.l_linenumber, o.l_partkey, o.l_suppkey, o.l_shipdate, o.l_extendedprice, o.l_quantity, o.l_discount, o.l_tax")
)
def open_set_predict(spark, d):
    df = lines(spark, d)
    two = ["l_quantity", "l_discount"]
    gate = lambda rows: lambda x, m=Ellipse(two).fit(rows): m.score(x).select(*x.columns, "inlier")
    model = openset.fit_open_set(df, LABEL, ["A", "R"], gate, lambda rows: openset.nearest_centroid(rows, two, LABEL))
    return model.predict(df).groupBy(LABEL, "predicted").agg(F.count(F.lit(1)).alias("n"))


# --- figures of merit -------------------------------------------------------------------------------------------

RULE_SQL = "CASE WHEN l_tax < 0.025 THEN 'A' WHEN l_tax < 0.055 THEN 'N' ELSE 'Unknown' END"


def ruled(spark, d) -> DataFrame:
    p = F.when(F.col("l_tax") < 0.025, "A").when(F.col("l_tax") < 0.055, "N").otherwise("Unknown")
    return lines(spark, d).withColumn("p", p)


@query(f"SELECT l_returnflag AS actual, {RULE_SQL} AS predicted, count(*) AS n FROM lineitem GROUP BY ALL")
def confusion_matrix(spark, d):
    return merit.confusion(ruled(spark, d), LABEL, "p")


@query(
    f"""WITH x AS (SELECT l_returnflag AS f, {RULE_SQL} AS p FROM lineitem), k AS (SELECT unnest(['A', 'N']) AS cls),
c AS (SELECT cls, count(*) FILTER (f = cls AND p = cls) / count(*) FILTER (f = cls) AS csns, 1 - count(*) FILTER (f <> cls AND p = cls) / count(*) FILTER (f <> cls) AS csps FROM x, k GROUP BY cls)
SELECT cls, round(csns, 6) AS csns, round(csps, 6) AS csps, round(sqrt(csns * csps), 6) AS ceff FROM c"""
)
def merit_by_class(spark, d):
    return rounded(merit.class_merit(ruled(spark, d), LABEL, "p", ["A", "N"]), 6)


@query(
    f"""WITH x AS (SELECT l_returnflag AS f, {RULE_SQL} AS p FROM lineitem), c AS (SELECT count(*) FILTER (f = p) / count(*) FILTER (f IN ('A', 'N')) AS tsns,
1 - count(*) FILTER (p IN ('A', 'N') AND p <> f) / count(*) AS tsps, count(*) FILTER (f = p OR (f = 'R' AND p = 'Unknown')) / count(*) AS acc FROM x)
SELECT round(tsns, 6) AS tsns, round(tsps, 6) AS tsps, round(acc, 6) AS acc, round(sqrt(tsns * tsps), 6) AS teff FROM c"""
)
def merit_total(spark, d):
    return rounded(merit.total_merit(ruled(spark, d), LABEL, "p", ["A", "N"], "Unknown"), 6)


@query(
    """WITH x AS (SELECT l_returnflag AS f, l_discount < 0.055 AS a, l_tax < 0.035 AS n FROM lineitem), c AS (SELECT (count(*) FILTER (f = 'A' AND a) + count(*) FILTER (f = 'N' AND n)) / count(*) FILTER (f IN ('A', 'N')) AS tsns,
1 - (count(*) FILTER (a AND f <> 'A') + count(*) FILTER (n AND f <> 'N')) / count(*) AS tsps, (count(*) FILTER (f = 'A' AND a) + count(*) FILTER (f = 'N' AND n) + count(*) FILTER (f = 'R' AND NOT a AND NOT n)) / count(*) AS acc FROM x)
SELECT round(tsns, 6) AS tsns, round(tsps, 6) AS tsps, round(acc, 6) AS acc, round(sqrt(tsns * tsps), 6) AS teff FROM c"""
)
def merit_soft(spark, d):
    some = F.array_compact(F.array(F.when(F.col("l_discount") < 0.055, "A"), F.when(F.col("l_tax") < 0.035, "N")))
    df = lines(spark, d).withColumn("p", F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("Unknown"))))
    return rounded(merit.total_merit(df, LABEL, "p", ["A", "N"], "Unknown", soft=True), 6)


@query(
    """WITH x AS (SELECT l_returnflag AS f, l_tax < 0.045 AS i FROM lineitem), t AS (SELECT avg(i::INT) FILTER (f = 'R') AS tsns, 1 - avg(i::INT) FILTER (f <> 'R') AS tsps, avg((i = (f = 'R'))::INT) AS acc FROM x)
SELECT f AS cls, round(1 - avg(i::INT), 6) AS csps, NULL::DOUBLE AS tsns, NULL::DOUBLE AS tsps, NULL::DOUBLE AS teff, NULL::DOUBLE AS acc FROM x WHERE f <> 'R' GROUP BY f
UNION ALL SELECT NULL, NULL, round(tsns, 6), round(tsps, 6), round(sqrt(tsns * tsps), 6), round(acc, 6) FROM t"""
)
def merit_one_class(spark, d):
    return rounded(merit.one_class_merit(lines(spark, d).withColumn("i", F.col("l_tax") < 0.045), LABEL, "i", "R"), 6)


# --- comparison -------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE g AS (SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS i FROM customer GROUP BY 1),
w AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS c_mktsegment, 0::BIGINT AS n, NULL::INT AS fold, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c UNION ALL
SELECT i, c_mktsegment, n, f, a + CASE WHEN f = 0 THEN n ELSE 0 END, b + CASE WHEN f = 1 THEN n ELSE 0 END, c + CASE WHEN f = 2 THEN n ELSE 0 END
FROM (SELECT g.i, g.c_mktsegment, g.n, a, b, c, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM w JOIN g ON g.i = w.i + 1))
SELECT c_mktsegment, n, fold FROM w WHERE i > 0"""
)
def group_folds(spark, d):
    return comparison.group_folds(table(spark, d, "customer"), "c_mktsegment", 3)


@query(
    "WITH s AS (SELECT l_suppkey % 5 AS r, l_partkey % 4 AS f, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL), m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a - b) AS dm, var_samp(a - b) AS v FROM s) SELECT n, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(dm, 6) AS mean_diff, round(dm / sqrt((1.0 / n + 0.25 / 0.75) * v), 3) AS t FROM m"
)
def corrected_t_stat(spark, d):
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("repeat"), (F.col("l_partkey") % 4).alias("fold")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    scores = s.select("repeat", "fold", F.explode(F.array(F.struct(F.lit("a").alias("estimator"), F.col("a").alias("score")), F.struct(F.lit("b").alias("estimator"), F.col("b").alias("score")))).alias("x")).select("repeat", "fold", "x.*")
    summary = comparison.with_corrected_t(comparison.paired_summary(scores, "a", "b"), 5)
    return rounded(summary.select("n", "mean_a", "mean_b", "mean_diff"), 6).join(rounded(summary.select("n", "t"), 3), "n")


@query(
    "WITH s AS (SELECT l_suppkey % 5 AS r, l_partkey % 4 AS f, avg(l_discount) AS a, avg(l_tax) AS b FROM lineitem GROUP BY ALL), l AS (SELECT 'a' AS estimator, a AS v FROM s UNION ALL SELECT 'b', b FROM s) SELECT estimator, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, (row_number() OVER (ORDER BY avg(v) DESC, estimator))::INT AS place FROM l GROUP BY estimator"
)
def ranked_scores(spark, d):
    s = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("repeat"), (F.col("l_partkey") % 4).alias("fold")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    return rounded(comparison.ranked(s.select("repeat", "fold", F.expr("stack(2, 'a', a, 'b', b) AS (estimator, score)"))), 6)


def _far_apart_sql(n: int) -> str:
    """One column: the farthest from the mean, then each time the farthest from all before; ties to the least key."""
    parts = ["x AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS v FROM supplier)", "c0 AS (SELECT s_suppkey, v FROM x ORDER BY abs(v) DESC, s_suppkey LIMIT 1)"]
    for k in range(1, n):
        near = ", ".join(f"abs(x.v - (SELECT v FROM c{j}))" for j in range(k))
        gone = ", ".join(f"(SELECT s_suppkey FROM c{j})" for j in range(k))
        parts.append(f"c{k} AS (SELECT s_suppkey, v FROM x WHERE s_suppkey NOT IN ({gone}) ORDER BY {f'least({near})' if k > 1 else near} DESC, s_suppkey LIMIT 1)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT s_suppkey, {k} AS place FROM c{k}" for k in range(n))


@query(_far_apart_sql(8))
def kennard_stone(spark, d):
    return comparison.kennard_stone(table(spark, d, "supplier"), ["s_acctbal"], "s_suppkey", 8)


@query()
def repeated_cv_pls(spark, d):
    folded = comparison.repeated_folds(lines(spark, d), [*ROW, "l_extendedprice"], 4, 3)
    return comparison.cross_validated_regression(folded, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [1, 2, 3])


@query("SELECT l_returnflag, k AS fold, (n + 4 - k) // 5 AS n FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT unnest(range(0, 5)) AS k)")
def stratified_folds(spark, d):
    df = comparison.stratified_folds(lines(spark, d), LABEL, [*ROW, *FEATURES], 5)
    return df.groupBy(LABEL, F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


# --- rebalancing and clusters -----------------------------------------------------------------------------------


def suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 3).cast("string").alias("cls"))


@query("WITH c AS (SELECT (s_nationkey % 3)::VARCHAR AS cls, count(*) AS n FROM supplier GROUP BY 1) SELECT cls, (SELECT max(n) FROM c) AS n FROM c")
def smote_counts(spark, d):
    return rebalance.smote(suppliers(spark, d), ["s_acctbal"], "cls", "s_suppkey").groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT s_suppkey, s_acctbal AS x, (s_nationkey % 3)::VARCHAR AS cls FROM supplier), sp AS (SELECT cls FROM s GROUP BY cls ORDER BY count(*), cls LIMIT 1),
n AS (SELECT a.s_suppkey, a.cls, b.cls AS vote, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY (a.x - b.x) ** 2, b.s_suppkey) AS k FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey WHERE a.cls NOT IN (SELECT cls FROM sp)),
g AS (SELECT s_suppkey FROM n WHERE k <= 3 GROUP BY s_suppkey HAVING count(*) FILTER (vote = cls) < 3)
SELECT s_suppkey, cls FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM g)"""
)
def edited_neighbours(spark, d):
    return rebalance.edited_neighbours(suppliers(spark, d), ["s_acctbal"], "cls", "s_suppkey").select("s_suppkey", "cls")


@query(
    """WITH s AS (SELECT s_suppkey, s_acctbal AS x, s_suppkey % 2 AS cls FROM supplier), n AS (SELECT a.s_suppkey, a.cls, b.cls AS vote, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.x - b.x), b.s_suppkey::VARCHAR) AS k FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey),
g AS (SELECT s_suppkey FROM n WHERE k <= 3 GROUP BY s_suppkey HAVING count(*) FILTER (vote = cls) < 2)
SELECT s_suppkey::VARCHAR AS s_suppkey, cls::VARCHAR AS cls, round(x, 4) AS s_acctbal FROM s WHERE s_suppkey NOT IN (SELECT s_suppkey FROM g)"""
)
def scaled_smote_enn_balanced(spark, d):
    """Two classes of the same size, to which SMOTE adds nothing: what the scaled neighbours leave."""
    df = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 2).cast("string").alias("cls"))
    return rounded(rebalance.scaled_smote_enn(df, ["s_acctbal"], "cls", "s_suppkey", kind="mode").select("s_suppkey", "cls", "s_acctbal"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey % 3 AS c FROM supplier), n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
p AS (SELECT a.k, a.c, b.c AS d, sum(sqrt((a.x - b.x) ** 2)) / (CASE WHEN a.c = b.c THEN nullif(n.n - 1, 0) ELSE n.n END) AS v FROM s a CROSS JOIN s b JOIN n ON n.c = b.c GROUP BY a.k, a.c, b.c, n.n),
q AS (SELECT k, c, max(v) FILTER (c = d) AS a, min(v) FILTER (c <> d) AS b FROM p GROUP BY k, c)
SELECT k AS s_suppkey, c::VARCHAR AS cls, round((b - a) / greatest(a, b), 4) + 0.0 AS silhouette FROM q"""
)
def silhouette(spark, d):
    return rounded(clusters.silhouettes(suppliers(spark, d), ["s_acctbal"], "cls", "s_suppkey"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey % 3 AS c FROM supplier), n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
p AS (SELECT a.k, a.c, b.c AS d, sum((a.x - b.x) ** 2) / (CASE WHEN a.c = b.c THEN nullif(n.n - 1, 0) ELSE n.n END) AS v FROM s a CROSS JOIN s b JOIN n ON n.c = b.c GROUP BY a.k, a.c, b.c, n.n),
q AS (SELECT k, c, max(v) FILTER (c = d) AS a, min(v) FILTER (c <> d) AS b FROM p GROUP BY k, c)
SELECT k AS s_suppkey, c::VARCHAR AS cls, round((b - a) / greatest(a, b), 4) + 0.0 AS silhouette FROM q"""
)
def silhouette_squared(spark, d):
    return rounded(clusters.squared_silhouettes(suppliers(spark, d), ["s_acctbal"], "cls", "s_suppkey"))


@query(
    """WITH s AS (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey * 100.0 AS y, c_mktsegment AS c FROM customer), n AS (SELECT c, count(*) AS n FROM s GROUP BY c),
p AS (SELECT a.k, a.c, b.c AS d, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / (CASE WHEN a.c = b.c THEN nullif(n.n - 1, 0) ELSE n.n END) AS v FROM s a CROSS JOIN s b JOIN n ON n.c = b.c GROUP BY a.k, a.c, b.c, n.n),
q AS (SELECT k, c, max(v) FILTER (c = d) AS a, min(v) FILTER (c <> d) AS b FROM p GROUP BY k, c)
SELECT k AS c_custkey, c AS c_mktsegment, round((b - a) / greatest(a, b), 4) + 0.0 AS silhouette FROM q"""
)
def silhouette_customers(spark, d):
    """Euclidean silhouettes of the market segments in two columns."""
    df = table(spark, d, "customer").withColumn("y", F.col("c_nationkey") * 100.0)
    return rounded(clusters.silhouettes(df, ["c_acctbal", "y"], "c_mktsegment", "c_custkey"))


@query()
def elbow(spark, d):
    return clusters.elbow(suppliers(spark, d), ["s_acctbal"], range(1, 5))


@query("SELECT o_orderkey, round(0.001 + 0.005 * greatest(0, 1 - abs(i / 8.0 - 2 * floor(1 + i / 16.0) + 1)) / 2 ** (floor(1 + i / 16.0) - 1), 7) AS rate FROM (SELECT o_orderkey, o_orderkey % 100 AS i FROM orders)")
def cyclical_rate(spark, d):
    """The rate at the step that each order's key stands for, halved every cycle."""
    step = F.col("o_orderkey") % 100
    return rounded(table(spark, d, "orders").select("o_orderkey", explain.cyclical_rate(step, 0.001, 0.006, 8, "triangular2").alias("rate")), 7)


@query(
    """WITH RECURSIVE r AS (SELECT hour(ts) AS i, 1e-4 * 1.2 ** hour(ts) AS rate, 10 + avg(value) AS loss FROM events GROUP BY hour(ts)),
m AS (SELECT -1::BIGINT AS i, 0::DOUBLE AS m, NULL::DOUBLE AS rate UNION ALL SELECT r.i, 0.98 * m.m + 0.02 * r.loss, r.rate FROM m JOIN r ON r.i = m.i + 1),
l AS (SELECT i, rate, m / (1 - 0.98 ** (i + 1)) AS loss FROM m WHERE i >= 0), f AS (SELECT *, loss - lag(loss) OVER (ORDER BY i) AS fall FROM l), t AS (SELECT arg_min(i, loss) AS i FROM f)
SELECT round(arg_min(rate, coalesce(fall, 0)), 7) AS base, round(max(rate), 7) AS top FROM f WHERE i <= (SELECT i FROM t)"""
)
def rate_pick(spark, d):
    """Ends of a cyclical rate from a sweep in which the hours of the day stand for the steps and the events' mean values for losses."""
    sweep = table(spark, d, "events").groupBy(F.hour("ts").alias("id")).agg((10 + F.avg("value")).alias("loss")).withColumn("rate", 1e-4 * F.pow(F.lit(1.2), "id"))
    return rounded(explain.pick_rates(sweep, "id", "rate", "loss"), 7)


CAM_SQL = """WITH l AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1) // 8 AS p, (generate_subscripts(embedding, 1) - 1) % 8 AS c, unnest(embedding)::DOUBLE AS v FROM embeddings),
g AS (SELECT vec_id, p AS c, {weight} AS g FROM l GROUP BY vec_id, p), r AS (SELECT l.vec_id, l.p, greatest(0, sum({product})) AS v FROM l JOIN {with} GROUP BY l.vec_id, l.p)
SELECT vec_id, p::BIGINT AS p, round(v / nullif(max(v) OVER (PARTITION BY vec_id), 0), 5) + 0.0 AS v FROM r"""


def cam(spark, d, elementwise: bool) -> DataFrame:
    """Eight places of eight channels; the gradients are the same numbers, places and channels exchanged."""
    at = lambda i: F.col("embedding")[i].cast("double")
    e = table(spark, d, "embeddings")
    one, two = (F.array(*[F.array(*[at(8 * p + c if k == 0 else 8 * c + p) for c in range(8)]) for p in range(8)]) for k in (0, 1))
    out = e.select("vec_id", F.posexplode(explain.activation_map(one, two, elementwise)).alias("p", "v"))
    return rounded(out.withColumn("p", F.col("p").cast("bigint")), 5)


@query(CAM_SQL.replace("{weight}", "avg(v)").replace("{product}", "l.v * g.g").replace("{with}", "g ON g.vec_id = l.vec_id AND g.c = l.c"))
def activation_map(spark, d):
    return cam(spark, d, False)


@query(CAM_SQL.replace("{weight}", "avg(v)").replace("{product}", "l.v * t.v").replace("{with}", "l t ON t.vec_id = l.vec_id AND t.p = l.c AND t.c = l.p"))
def activation_map_elementwise(spark, d):
    return cam(spark, d, True)


@query(
    """WITH e AS (SELECT vec_id, embedding[1:24]::DOUBLE[] AS x, embedding[25:32]::DOUBLE[] AS m FROM embeddings), p AS (SELECT vec_id, x, m, unnest(range(0, 24)) AS i FROM e),
q AS (SELECT *, i * 7 / 23.0 AS y FROM p), u AS (SELECT *, m[floor(y)::INT + 1] + (m[least(7, floor(y)::INT + 1) + 1] - m[floor(y)::INT + 1]) * (y - floor(y)) AS up FROM q)
SELECT vec_id, i, round(x[i + 1], 5) + 0.0 AS value, round((up - list_min(m)) / (list_max(m) - list_min(m)), 5) + 0.0 AS color FROM u"""
)
def color_series(spark, d):
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda v: v.cast("double"))
    out = explain.color_table(table(spark, d, "embeddings"), "vec_id", part(1, 24), part(25, 8), 24)
    return rounded(out.withColumn("i", F.col("i").cast("bigint")), 5)


# Further queries register themselves here; they need the helpers above.
from sparkchemo.plans import selection  # noqa: E402, F401
