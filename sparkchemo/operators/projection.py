"""Projection models with acceptance limits: PCA, SIMCA, DD-SIMCA, PCR, PLS, PLS-DA and ellipses.

Every fit is a few aggregates, small linear algebra on the driver, and a model whose
scores are column expressions: h is the squared distance in score space, q the squared
residual, and both follow scaled chi-squared laws whose degrees of freedom come from the
training rows' moments or quartiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkchemo.functions.expr import chi2_tail, inlier_probability, linear, quadratic, total
from sparkchemo.functions.quantiles import order_statistics, quantiles
from sparkchemo.functions.special import chi2_ppf, f_ppf, minimise_1d
from sparkchemo.operators.mcd import minimum_covariance
from sparkchemo.operators.moments import Moments, grouped_moments, moments


def degrees_of_freedom(df: DataFrame, columns: Sequence[str], robust: bool) -> dict[str, tuple[int, float]]:
    """(N, u0) of each non-negative column, so that N * u / u0 is about chi-squared with N degrees."""
    if robust:
        row = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
        return {c: _robust_dof(row[c][1], row[c][2] - row[c][0]) for c in columns}
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_samp(c).alias(f"v_{c}") for c in columns]).first()
    out = {}
    for c in columns:
        u0, v = row[f"m_{c}"], row[f"v_{c}"]
        out[c] = (max(int(np.round(2 * u0 * u0 / v)), 1) if v else 1, u0)
    return out


def _robust_dof(median: float, iqr: float) -> tuple[int, float]:
    """By the median and the interquartile range alone."""

    def spread(n: float) -> tuple[float, float]:
        n = max(n, 1.0)
        return chi2_ppf(0.75, n) - chi2_ppf(0.25, n), chi2_ppf(0.5, n)

    def miss(n: float) -> float:
        width, mid = spread(n)
        return (width * median / mid - iqr) ** 2

    n, good = minimise_1d(miss, 1.0)
    if not good:
        # Fixed values of the closed form: exponents and factor of the fitted law.
        a, b, c = 0.72414, 2.68631, 0.84332
        arg = b * median / iqr
        n = 1 if arg < 1 else math.exp((math.log(arg) / a) ** (1 / c))
    n = max(int(np.round(n)), 1)
    width, mid = spread(n)
    return n, 0.5 * n * (median / mid + iqr / width)


def principal_axes(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors as columns."""
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    return value[order], vector[:, order]


@dataclass(frozen=True)
class Subspace:
    """Centre, scale and axes of a projection; its expressions give scores, h and q of any row."""

    columns: tuple[str, ...]
    center: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    def x(self) -> list[Column]:
        return [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.center, self.scale, strict=True)]

    def scores(self) -> list[Column]:
        return [linear(self.x(), a) for a in self.axes.T]

    def h(self) -> Column:
        return total([t * t / F.lit(float(v)) for t, v in zip(self.scores(), self.variances, strict=True)])

    def q(self, original_units: bool = False) -> Column:
        x, t = self.x(), self.scores()
        rest = [xi - linear(t, row) for xi, row in zip(x, self.axes, strict=True)]
        return total([r * r * F.lit(float(s * s if original_units else 1.0)) for r, s in zip(rest, self.scale, strict=True)])


def fit_subspace(df: DataFrame, columns: Sequence[str], k: int, scale: bool, signs: bool = True) -> tuple[Subspace, Moments]:
    """PCA of some columns. An axis points so that the row farthest along it is positive, if ``signs`` (one scan more)."""
    m = moments(df, columns)
    s = np.sqrt(np.diag(m.covariance)) if scale else np.ones(len(columns))
    if (s < 1e-18).any():
        raise ValueError("a column does not vary")
    value, vector = principal_axes(m.scaled(s).covariance, k)
    space = Subspace(tuple(columns), m.mean, s, vector, value)
    if signs:
        t = space.scores()
        row = df.agg(*[F.max_by(c, F.abs(c)).alias(f"t{i}") for i, c in enumerate(t)]).first()
        space = replace(space, axes=vector * np.array([-1.0 if row[f"t{i}"] < 0 else 1.0 for i in range(k)]))
    return space, m


@dataclass(frozen=True)
class PCAModel:
    """PCA with limits: regular below c_crit, extreme below c_out, else outlier."""

    space: Subspace
    alpha: float
    gamma: float | None
    n: int
    dof_h: tuple[int, float]
    dof_q: tuple[int, float]
    history: tuple = ()

    def critical(self, alpha: float) -> float:
        return chi2_ppf(1 - alpha, self.dof_h[0] + self.dof_q[0])

    @property
    def c_crit(self) -> float:
        return self.critical(self.alpha)

    @property
    def c_out(self) -> float:
        return self.c_crit if self.gamma is None else chi2_ppf((1 - self.gamma) ** (1 / self.n), self.dof_h[0] + self.dof_q[0])

    def distance(self, h: Column | None = None, q: Column | None = None) -> Column:
        (nh, h0), (nq, q0) = self.dof_h, self.dof_q
        return (self.space.h() if h is None else h) * (nh / h0) + (self.space.q() if q is None else q) * (nq / q0)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with h, q, distance, decision, inlier_probability, inlier, extreme and outlier."""
        out = df.withColumns({"h": self.space.h(), "q": self.space.q()})
        out = out.withColumn("distance", self.distance(F.col("h"), F.col("q")))
        c = F.col("distance")
        out = out.withColumns({"decision": math.sqrt(self.c_crit) - F.sqrt(c), "inlier": c < self.c_crit, "extreme": (c >= self.c_crit) & (c < self.c_out), "outlier": c >= self.c_out})
        return out.withColumn("inlier_probability", inlier_probability(F.col("decision")))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"pc{k + 1}": t for k, t in enumerate(self.space.scores())})

    def loadings(self, spark: SparkSession) -> DataFrame:
        """(component, feature, loading, explained): the axes as a table; ``explained`` is the component's variance."""
        space = self.space
        rows = [(k + 1, c, float(space.axes[i, k]), float(space.variances[k])) for k in range(space.axes.shape[1]) for i, c in enumerate(space.columns)]
        return spark.createDataFrame(rows, "component int, feature string, loading double, explained double")

    def extremes(self, df: DataFrame, upper_share: float = 0.25) -> DataFrame:
        """Expected against observed extremes: the fit stays, only the cut-off moves with alpha."""
        tail = chi2_tail(F.col("c"), self.dof_h[0] + self.dof_q[0])
        return extremes_table(df, self.distance(), F.ceil(F.lit(self.n) * tail), max(1, int(self.n * upper_share)), self.n)

    def loss(self, df: DataFrame, truth: str) -> DataFrame:
        return log_loss(self.score(df), truth)


def log_loss(scored: DataFrame, truth: str, eps: float = 1e-15) -> DataFrame:
    """(loss, accuracy): the mean log loss of ``inlier_probability`` and the share of right ``inlier`` against a boolean column."""
    p = F.least(F.greatest(F.col("inlier_probability"), F.lit(eps)), F.lit(1 - eps))
    return scored.agg(F.avg(-F.log(F.when(F.col(truth), p).otherwise(1 - p))).alias("loss"), F.avg((F.col("inlier") == F.col(truth)).cast("double")).alias("accuracy"))


#: Expected counts whose running sum one task makes.
STEP = 100_000


def extremes_table(df: DataFrame, distance: Column, first: Column, top: int, n: int) -> DataFrame:
    """(expected, observed, low, high) for 1 to ``top`` expected extremes of ``n``, with the band of two deviations.

    ``first`` is the least expected count whose cut-off a row passes, from the tail probability of its ``distance``, column c: so the rows are counted by
    it, and the counts added up, without a cut-off being worked out for any count.
    """
    # The generator keeps the planner from working the distance out anew wherever the tail uses it.
    by = df.select(F.explode(F.array(distance)).alias("c")).select(F.greatest(F.lit(1), first).cast("bigint").alias("expected")).where(F.col("expected") <= top).groupBy("expected").agg(F.count(F.lit(1)).alias("m"))
    grid = df.sparkSession.range(1, top + 1).withColumnRenamed("id", "expected")
    each = grid.join(by, "expected", "left").select("expected", F.coalesce("m", F.lit(0)).alias("m"), F.floor(F.col("expected") / STEP).alias("part"))
    sums = each.groupBy("part").agg(F.sum("m").alias("m"))  # top / STEP rows
    ahead = sums.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("ahead"))
    inside = F.sum("m").over(Window.partitionBy("part").orderBy("expected"))
    counts = each.join(ahead, "part").select(F.col("expected").cast("int").alias("expected"), (F.col("ahead") + inside).alias("observed"))
    band = 2 * F.sqrt(F.col("expected") * (1 - F.col("expected") / n))
    return counts.select("expected", "observed", (F.col("expected") - band).alias("low"), (F.col("expected") + band).alias("high"))


@dataclass(frozen=True)
class PCA:
    """``robust``: 'semi' takes degrees of freedom from quartiles, 'classical' from moments.

    ``capped``: too many components are cut down (the authenticators' way) instead of an error.
    ``clean``: drop outliers and refit until none is left, take back what then looks regular,
    and end with a classical fit; an error if that takes over 100 rounds.
    """

    columns: Sequence[str]
    n_components: int = 1
    alpha: float = 0.05
    gamma: float | None = 0.01
    scale: bool = False
    robust: str = "semi"
    clean: bool = False
    capped: bool = False

    def fit(self, df: DataFrame) -> PCAModel:
        if self.robust not in ("semi", "classical"):
            raise ValueError("robust is 'semi' or 'classical'")
        if not self.clean:
            return self._once(df, self.robust == "semi")
        if self.gamma is None:
            raise ValueError("cleaning needs gamma")
        model, kept, history = self._once(df, True), F.lit(True), []
        for _ in range(100):
            for _ in range(100):
                part = df.where(kept)
                model = self._once(part, True)
                bad = part.where(model.distance() >= model.c_out).limit(1).count()
                if not bad:
                    break
                kept = kept & (model.distance() < model.c_out)
            regular = model.distance() < model.c_out
            back = df.where(~kept & regular).limit(1).count()
            history.append((model.n, bool(back)))
            if not back:
                return replace(self._once(df.where(kept), False), history=tuple(history))
            kept = kept | regular
        raise RuntimeError("cleaning did not settle in 100 rounds")

    def _once(self, df: DataFrame, robust: bool) -> PCAModel:
        p = len(self.columns)
        df = df.dropna(subset=list(self.columns))
        n = df.count()
        most = max(1, min(n, p) - 1) if self.capped else min(n - 1, p)
        if not 1 <= self.n_components <= most and not self.capped:
            raise ValueError(f"n_components must be in 1..{most}")
        space, m = fit_subspace(df, self.columns, min(self.n_components, most), self.scale)
        hq = df.select(space.h().alias("h"), space.q().alias("q"))
        dof = degrees_of_freedom(hq, ["h", "q"], robust)
        return PCAModel(space, self.alpha, self.gamma, m.n, dof["h"], dof["q"])


@dataclass(frozen=True)
class SIMCAModel:
    """Classical SIMCA: an F test on the residual in original units."""

    space: Subspace
    alpha: float
    a: int
    n: int
    train_residual: float

    @property
    def f_crit(self) -> float:
        k = self.space.axes.shape[1]
        return f_ppf(1 - self.alpha, self.a - k, (self.a - k) * (self.n - k - 1))

    def distance(self) -> Column:
        k = self.space.axes.shape[1]
        return (self.space.q(True) / (self.a - k)) / (self.train_residual / ((self.a - k) * (self.n - k - 1)))

    def score(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("distance", self.distance())
        out = out.withColumns({"decision": math.sqrt(self.f_crit) - F.sqrt("distance"), "inlier": F.col("distance") < self.f_crit})
        return out.withColumn("inlier_probability", inlier_probability(F.col("decision")))

    def loss(self, df: DataFrame, truth: str) -> DataFrame:
        return log_loss(self.score(df), truth)


@dataclass(frozen=True)
class SIMCA:
    columns: Sequence[str]
    n_components: int = 1
    alpha: float = 0.05
    scale: bool = True

    def fit(self, df: DataFrame) -> SIMCAModel:
        df = df.dropna(subset=list(self.columns))
        p, n = len(self.columns), df.count()
        space, _ = fit_subspace(df, self.columns, min(self.n_components, max(1, min(p, n) - 1)), self.scale, signs=False)
        residual = df.agg(F.sum(space.q(True)).alias("s")).first()["s"]
        return SIMCAModel(space, self.alpha, p if n > p else n - 1, n, residual)


@dataclass(frozen=True)
class Authenticator:
    """A one-class model of ``target`` rows; ``use`` names the score: rigorous, compliant or acc."""

    model: PCA | SIMCA | Ellipse
    label: str
    target: str
    use: str = "rigorous"

    def fit(self, df: DataFrame):
        return self.model.fit(df.where(F.col(self.label) == self.target))

    def metrics(self, fitted, df: DataFrame) -> DataFrame:
        """tsns, tsps, teff, acc and score in one scan; undefined rates are null."""
        target = F.col(self.label) == self.target
        scored = fitted.score(df)
        sns = F.avg(F.when(target, F.col("inlier").cast("double")))
        sps = 1 - F.avg(F.when(~target, F.col("inlier").cast("double")))
        acc = F.avg((F.col("inlier") == target).cast("double"))
        out = scored.agg(sns.alias("tsns"), sps.alias("tsps"), acc.alias("acc"))
        out = out.withColumn("teff", F.coalesce(F.sqrt(F.col("tsns") * F.col("tsps")), "tsns", "tsps"))
        score = {"rigorous": -F.pow(F.col("tsns") - (1 - self.model.alpha), 2), "compliant": F.col("teff"), "acc": F.col("acc")}[self.use]
        return out.withColumn("score", score)


@dataclass(frozen=True)
class EllipseModel:
    """Mahalanobis distance in a low-dimensional space; a row on the boundary is an inlier."""

    columns: tuple[str, ...]
    center: np.ndarray
    covariance: np.ndarray
    alpha: float

    @property
    def d_crit(self) -> float:
        return chi2_ppf(1 - self.alpha, len(self.columns))

    def distance(self) -> Column:
        x = [F.col(c) - F.lit(float(m)) for c, m in zip(self.columns, self.center, strict=True)]
        return F.sqrt(quadratic(x, np.linalg.inv(self.covariance)))

    def score(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("distance", self.distance())
        out = out.withColumns({"decision": math.sqrt(self.d_crit) - F.col("distance"), "inlier": F.col("distance") <= math.sqrt(self.d_crit)})
        return out.withColumn("inlier_probability", inlier_probability(F.col("decision")))

    def loss(self, df: DataFrame, truth: str) -> DataFrame:
        return log_loss(self.score(df), truth)

    def extremes(self, df: DataFrame, n: int, upper_share: float = 0.25) -> DataFrame:
        """Expected against observed extremes of ``n`` training rows: the fit stays, only the cut-off moves with alpha."""
        tail = chi2_tail(F.col("c") * F.col("c"), len(self.columns))
        return extremes_table(df, self.distance(), F.floor(F.lit(n) * tail) + 1, max(1, int(n * upper_share)), n)

    def shape(self) -> list[tuple[float, float]]:
        """(half axis, angle) of the boundary, longest first; in one dimension the half width."""
        value, vector = principal_axes(self.covariance, len(self.columns))
        return [(math.sqrt(v * self.d_crit), math.atan2(a[1], a[0]) if len(a) > 1 else 0.0) for v, a in zip(value, vector.T, strict=True)]


@dataclass(frozen=True)
class Ellipse:
    """Empirical covariance about the mean; ``robust`` 'mcd' takes the reweighted minimum covariance determinant.

    ``robust`` True is the shorter way of one start, the median: rounds keep the half of the rows nearest to the centre
    (C-steps), each one aggregate; the result is rescaled so that the median distance fits its chi-squared law. A
    cluster of outliers near the median can hold it, which the many starts of 'mcd' do not let happen. With
    ``center`` the location is given ('mcd' only).
    """

    columns: Sequence[str]
    alpha: float = 0.05
    robust: bool | str = False
    rounds: int = 10
    center: Sequence[float] | None = None
    seed: int = 0

    def fit(self, df: DataFrame) -> EllipseModel:
        if self.robust == "mcd":
            _, shape = minimum_covariance(df, self.columns, center=self.center, seed=self.seed)
            return EllipseModel(tuple(self.columns), shape.location, shape.covariance, self.alpha)
        df = df.dropna(subset=list(self.columns))
        m = moments(df, self.columns)
        model = EllipseModel(tuple(self.columns), m.mean, m.covariance, self.alpha)
        if not self.robust:
            return model
        x = df.select(*self.columns).persist()
        try:
            med = quantiles(x, {c: F.col(c) for c in self.columns}, [0.5])
            model = replace(model, center=np.array([med[c][0] for c in self.columns], float))
            last = math.inf
            for _ in range(self.rounds):
                _, m = nearest_half(x, model)
                model = replace(model, center=m.mean, covariance=m.covariance)
                size = float(np.linalg.det(m.covariance))
                if size >= last * (1 - 1e-12):
                    break
                last = size
            mid, _ = nearest_half(x, model)
        finally:
            x.unpersist()
        return replace(model, covariance=model.covariance * (mid * mid / chi2_ppf(0.5, len(self.columns))))


def nearest_half(x: DataFrame, model: EllipseModel, bins: int = 4096) -> tuple[float, Moments]:
    """The median distance of the rows, and the moments of those that are no farther: two scans.

    The first takes number and sums by bin of the distance (of d / (1 + d), so that no ends are needed); the bins below the
    median's count whole. The second reads the rows of the median's bin, which is searched by itself.
    """
    columns, p = model.columns, len(model.columns)
    c = [F.col(name) - F.lit(float(m)) for name, m in zip(columns, model.center, strict=True)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    far = x.withColumn("_d", model.distance()).where(~F.isnan("_d"))
    placed = far.withColumn("_bin", F.when(F.col("_d") < 1e15, F.floor(F.col("_d") / (1 + F.col("_d")) * bins)).otherwise(bins))
    aggregates = [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs]]
    table = sorted(placed.groupBy("_bin").agg(*aggregates).collect(), key=lambda r: r["_bin"])
    n = sum(r["n"] for r in table)
    low, high = (n - 1) // 2, n // 2
    ends = np.cumsum([r["n"] for r in table])
    first, final = (int(np.searchsorted(ends, k, "right")) for k in (low, high))
    before = int(ends[first] - table[first]["n"])
    inner = placed.where(F.col("_bin").between(table[first]["_bin"], table[final]["_bin"])).persist()
    try:
        at = order_statistics(inner, {"d": F.col("_d")}, lambda _: {low - before, high - before})["d"][1]
        cut = at[low - before] + (at[high - before] - at[low - before]) * ((n - 1) * 0.5 - low)
        kept = [*table[:first], inner.where(F.col("_d") <= F.lit(cut)).agg(*aggregates).first()]
    finally:
        inner.unpersist()
    rows = sum(r["n"] for r in kept)
    s, m = np.array([math.fsum(r[f"s{i}"] or 0.0 for r in kept) for i in range(p)]), np.zeros((p, p))
    for i, j in pairs:
        m[i, j] = m[j, i] = math.fsum(r[f"p{i}_{j}"] or 0.0 for r in kept)
    return cut, Moments(tuple(columns), rows, model.center + s / rows, m - np.outer(s, s) / rows)


@dataclass(frozen=True)
class RegressionModel:
    """A latent-variable regression with limits on x alone (f) and on x and y (g)."""

    space: Subspace
    projector: np.ndarray
    coefficients: np.ndarray
    intercept: float
    alpha: float
    gamma: float
    n: int
    dof: dict[str, tuple[int, float]]

    def scores(self) -> list[Column]:
        return [linear(self.space.x(), r) for r in self.projector.T]

    def predict(self) -> Column:
        return linear([F.col(c) for c in self.space.columns], self.coefficients) + F.lit(float(self.intercept))

    def h(self) -> Column:
        return total([t * t / F.lit(float(v)) for t, v in zip(self.scores(), self.space.variances, strict=True)])

    def q(self) -> Column:
        t = self.scores()
        return total([(x - linear(t, row)) * (x - linear(t, row)) for x, row in zip(self.space.x(), self.space.axes, strict=True)])

    def limits(self) -> dict[str, float]:
        nf = self.dof["h"][0] + self.dof["q"][0]
        ng, share = nf + self.dof["z"][0], (1 - self.gamma) ** (1 / self.n)
        return {"x_crit": chi2_ppf(1 - self.alpha, nf), "x_out": chi2_ppf(share, nf), "xy_crit": chi2_ppf(1 - self.alpha, ng), "xy_out": chi2_ppf(share, ng)}

    def score(self, df: DataFrame, y: str | None = None) -> DataFrame:
        """``df`` with predicted, h, q, f, x_extreme, x_outlier; with ``y`` also z, g, xy_extreme, xy_outlier."""
        (nh, h0), (nq, q0), (nz, z0) = (self.dof[k] for k in "hqz")
        cut = self.limits()
        out = df.withColumns({"predicted": self.predict(), "h": self.h(), "q": self.q()})
        out = out.withColumn("f", F.col("h") * (nh / h0) + F.col("q") * (nq / q0))
        out = out.withColumns({"x_extreme": (F.col("f") >= cut["x_crit"]) & (F.col("f") < cut["x_out"]), "x_outlier": F.col("f") >= cut["x_out"]})
        if y:
            out = out.withColumn("z", F.pow(F.col(y) - F.col("predicted"), 2))
            out = out.withColumn("g", F.col("f") + F.col("z") * (nz / z0))
            out = out.withColumns({"xy_extreme": (F.col("g") >= cut["xy_crit"]) & (F.col("g") < cut["xy_out"]), "xy_outlier": F.col("g") >= cut["xy_out"]})
        return out

    def r2(self, df: DataFrame, y: str) -> DataFrame:
        out = df.select(F.col(y).alias("y"), self.predict().alias("p"))
        return out.agg((1 - F.sum(F.pow(F.col("y") - F.col("p"), 2)) / (F.var_pop("y") * F.count("y"))).alias("r2"))


@dataclass(frozen=True)
class LatentRegression:
    """``kind`` 'pls' takes directions of covariance with y (from X'X and X'y alone), 'pcr' principal axes."""

    columns: Sequence[str]
    y: str
    n_components: int = 1
    kind: str = "pls"
    alpha: float = 0.05
    gamma: float = 0.01
    scale: bool = False
    robust: bool = True

    def _directions(self, m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scales, products of the scaled columns, loadings, rotations, slope in scaled units); the last column of ``m`` is y."""
        p = len(self.columns)
        s = np.sqrt(np.diag(m.covariance)[:p]) if self.scale else np.ones(p)
        xx, xy = m.products[:p, :p] / np.outer(s, s), m.products[:p, p] / s
        if self.kind == "pls":
            _, rotation, loading, inner = kernel_pls(xx, xy[:, None], self.n_components)
            return s, xx, loading, rotation, rotation @ inner[:, 0]
        _, loading = principal_axes(xx, self.n_components)
        return s, xx, loading, loading, loading @ np.linalg.solve(loading.T @ xx @ loading, loading.T @ xy)

    def coefficients(self, m: Moments) -> tuple[np.ndarray, float]:
        """The fit's (slopes, intercept) in the columns' units, from moments alone."""
        s, *_, slope = self._directions(m)
        slope = slope / s
        return slope, float(m.mean[-1] - slope @ m.mean[:-1])

    def fit(self, df: DataFrame) -> RegressionModel:
        p = len(self.columns)
        m = moments(df, [*self.columns, self.y])
        if not 1 <= self.n_components <= min(m.n - 1, p):
            raise ValueError(f"n_components must be in 1..{min(m.n - 1, p)}")
        df = df.dropna(subset=[*self.columns, self.y])
        s, xx, loading, rotation, slope = self._directions(m)
        variance = np.diag(rotation.T @ xx @ rotation) / (m.n - 1)
        space = Subspace(tuple(self.columns), m.mean[:p], s, loading, variance)
        coefficients = slope / s
        model = RegressionModel(space, rotation, coefficients, float(m.mean[p] - coefficients @ m.mean[:p]), self.alpha, self.gamma, m.n, {})
        hqz = df.select(model.h().alias("h"), model.q().alias("q"), F.pow(F.col(self.y) - model.predict(), 2).alias("z"))
        return replace(model, dof=degrees_of_freedom(hqz, ["h", "q", "z"], self.robust))


def kernel_pls(xx: np.ndarray, xy: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, rotations, x loadings, y loadings by component) from products of centred columns."""
    p = len(xx)
    w, r, load, q = np.zeros((p, k)), np.zeros((p, k)), np.zeros((p, k)), np.zeros((k, xy.shape[1]))
    left = xy.copy()
    for a in range(k):
        if left.shape[1] == 1:
            v = left[:, 0]
        else:
            value, vector = np.linalg.eigh(left.T @ left)
            v = left @ vector[:, -1]
        v = v / np.linalg.norm(v)
        v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
        w[:, a] = v
        rot = v.copy()
        for b in range(a):
            rot -= (load[:, b] @ v) * r[:, b]
        r[:, a] = rot
        tt = rot @ xx @ rot
        load[:, a], q[a] = xx @ rot / tt, xy.T @ rot / tt
        left = left - np.outer(load[:, a], q[a]) * tt
    return w, r, load, q


def variable_importance(xx: np.ndarray, xy: np.ndarray, k: int, rotations: bool = False) -> np.ndarray:
    """Importance of each column in a PLS projection; the mean of the squares is 1."""
    w, r, _, q = kernel_pls(xx, xy, k)
    v = r if rotations else w
    v = v / np.linalg.norm(v, axis=0)
    tt = np.array([r[:, a] @ xx @ r[:, a] for a in range(k)])
    s = tt * (q * q).sum(1)
    return np.sqrt(len(xx) * (v**2 @ s) / s.sum())


@dataclass(frozen=True)
class DiscriminantModel:
    """PLS-DA: squared distances to class centres in the space of predicted memberships."""

    columns: tuple[str, ...]
    classes: tuple[str, ...]
    coefficients: np.ndarray
    intercept: np.ndarray
    centers: np.ndarray
    inverse: dict[str, np.ndarray]
    determinant: dict[str, float]
    style: str
    alpha: float
    d_out: dict[str, float]
    not_assigned: str
    #: Soft: mean, whitening coefficients and whitened way from the centre to the mean, by class (see ``_whitened``).
    about_mean: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @property
    def d_crit(self) -> float:
        return chi2_ppf(1 - self.alpha, len(self.classes) - 1)

    def scores(self) -> list[Column]:
        x = [F.col(c) for c in self.columns]
        return [linear(x, b) + F.lit(float(a)) for b, a in zip(self.coefficients.T, self.intercept, strict=True)]

    def distances(self) -> dict[str, Column]:
        t, out = self.scores(), {}
        for i, c in enumerate(self.classes):
            if c in self.about_mean:
                mean, white, way = self.about_mean[c]
                x = [F.col(name) - F.lit(float(m)) for name, m in zip(self.columns, mean, strict=True)]
                w = [linear(x, b) for b in white.T]
                along = F.lit(1.0) - linear(w, way)
                out[c] = total([v * v for v in w]) + (F.lit(1.0) - along * along / F.lit(float(1 + way @ way)))
            else:
                out[c] = quadratic([a - F.lit(float(m)) for a, m in zip(t, self.centers[i], strict=True)], self.inverse[c])
        return out

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with d2 (by class), probability (by class) and predicted (all classes, nearest first)."""
        d = self.distances()
        out = df.withColumns({f"d2_{c}": v for c, v in d.items()})
        near = F.array_sort(F.array(*[F.struct(F.col(f"d2_{c}").alias("d2"), F.lit(c).alias("c")) for c in self.classes]))
        if self.style == "soft":
            inside = F.transform(F.filter(near, lambda x: x["d2"] < self.d_crit), lambda x: x["c"])
            predicted = F.when(F.size(inside) > 0, inside).otherwise(F.array(F.lit(self.not_assigned)))
            k = len(self.classes) - 1
            dense = [F.least(F.lit(1.0), F.exp(-F.col(f"d2_{c}") / 2) / math.sqrt((2 * math.pi) ** k * self.determinant[c])) for c in self.classes]
        else:
            predicted = F.array(near[0]["c"])
            least = near[0]["d2"]
            raw = [F.exp((least - F.col(f"d2_{c}")) / 2) for c in self.classes]
            dense = [r / total(raw) for r in raw]
        return out.withColumns({"predicted": predicted, **{f"p_{c}": v for c, v in zip(self.classes, dense, strict=True)}})

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The nearest class of each row of a matrix of the columns, the first by name among equals."""
        t, d = x @ self.coefficients + self.intercept, []
        for i, c in enumerate(self.classes):
            if c in self.about_mean:
                mean, white, way = self.about_mean[c]
                w = (x - mean) @ white
                d.append((w * w).sum(1) + (1 - (1 - w @ way) ** 2 / (1 + way @ way)))
            else:
                g = t - self.centers[i]
                d.append(np.einsum("ij,jk,ik->i", g, self.inverse[c], g))
        return np.array(self.classes, object)[np.stack(d, 1).argmin(1)]

    def outliers(self, df: DataFrame, label: str) -> DataFrame:
        """Training rows farther from their own class than its outlier limit (soft only)."""
        far = F.lit(False)
        for c, d in self.distances().items():
            far = far | ((F.col(label) == c) & (d > self.d_out[c]))
        return df.where(far)


@dataclass(frozen=True)
class PLSDA:
    columns: Sequence[str]
    label: str
    n_components: int = 1
    style: str = "soft"
    alpha: float = 0.05
    gamma: float = 0.01
    scale: bool = True
    not_assigned: str = "NOT_ASSIGNED"

    def fit(self, df: DataFrame) -> DiscriminantModel:
        """All from per-class moments in one pass: predictions are linear in x, so their moments are too."""
        return self.from_groups(grouped_moments(df.where(F.col(self.label).isNotNull()), self.columns, [self.label]))

    def from_groups(self, groups: dict[tuple, Moments]) -> DiscriminantModel:
        """The model from the moments of each class."""
        p = len(self.columns)
        classes = tuple(sorted(k[0] for k in groups))
        if len(classes) < 2:
            raise ValueError("at least two classes are needed")
        parts = [groups[c,] for c in classes]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole + part
        if not 1 <= self.n_components <= min(whole.n - 1, p):
            raise ValueError(f"n_components must be in 1..{min(whole.n - 1, p)}")
        s = np.sqrt(np.diag(whole.covariance)) if self.scale else np.ones(p)
        xy = np.stack([part.n * (part.mean - whole.mean) / s for part in parts], 1)
        _, rotation, _, inner = kernel_pls(whole.products / np.outer(s, s), xy, self.n_components)
        slope = (rotation @ inner) / s[:, None]
        share = np.array([part.n / whole.n for part in parts])
        cov_y = slope.T @ whole.covariance @ slope
        value, axes = principal_axes(cov_y, len(classes) - 1)
        coefficients = slope @ axes
        # A score is the prediction less its mean (the class shares) along an axis.
        intercept = -coefficients.T @ whole.mean
        centers = (np.eye(len(classes)) - share) @ axes
        inverse, det, out, about = {}, {}, {}, {}
        for i, (c, part) in enumerate(zip(classes, parts, strict=True)):
            if self.style == "soft":
                off = coefficients.T @ (part.mean - whole.mean) - centers[i]
                spread = coefficients.T @ part.products @ coefficients / part.n
                scatter = positive_definite(spread + np.outer(off, off))
                white = _whitened(spread)
                if white is not None:
                    about[c] = (part.mean, coefficients @ white, white.T @ off)
            else:
                scatter = np.diag(value)
            inverse[c], det[c] = np.linalg.inv(scatter), float(np.linalg.det(spread) * (1 + about[c][2] @ about[c][2]) if c in about else np.linalg.det(scatter))
            out[c] = chi2_ppf((1 - self.gamma) ** (1 / part.n), len(classes) - 1)
        return DiscriminantModel(tuple(self.columns), classes, coefficients, intercept, centers, inverse, det, self.style, self.alpha, out, self.not_assigned, about)


def _whitened(spread: np.ndarray) -> np.ndarray | None:
    """W with W'CW = 1 for the spread C of a class about its own mean; None if C has no inverse.

    The second moments about a far centre are C + uu', u the way from there to the mean, all but singular if the
    classes hardly differ. With w = W'(t - mean) and v = W'u the squared distance is 1 + w'w - (1 - v'w)^2 / (1 + v'v), in which nothing cancels.
    """
    value, vector = np.linalg.eigh((spread + spread.T) / 2)
    return vector / np.sqrt(value) if value.min() > max(value.max(), 1e-300) * 1e-12 else None


def positive_definite(m: np.ndarray) -> np.ndarray:
    """The matrix with eigenvalues lifted until it has a Cholesky factor."""
    value, vector = np.linalg.eigh((m + m.T) / 2)
    floor = max(value.max(), 1e-300) * 1e-14
    for _ in range(100):
        fixed = vector @ np.diag(np.maximum(value, floor)) @ vector.T
        try:
            np.linalg.cholesky(fixed)
            return m if value.min() >= floor else fixed
        except np.linalg.LinAlgError:
            floor *= 10
    raise ValueError("the matrix cannot be made positive definite")
