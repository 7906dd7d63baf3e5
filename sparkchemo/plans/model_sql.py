"""SQL that checks the projection models: pieces of a ``WITH RECURSIVE`` list, in another way than the library's.

Axes come as projectors, by squaring a covariance matrix until one direction is left, and
quantiles of chi-squared by halving an interval around its series. Scores' signs never matter.
"""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 50


def cell(name: str, i: int, j: int) -> str:
    return f"{name}_{min(i, j)}_{max(i, j)}"


def cells(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def chi2(name: str, ask: str) -> str:
    """``name`` (id, p, n, x): the p quantile of chi-squared with n degrees for each row of the query ``ask`` (id, p, n)."""
    series = "list_sum(list_transform(range(0, 100 + ceil(lo + hi)::INT), lambda t: exp((n / 2 + t) * ln((lo + hi) / 4) - (lo + hi) / 4 - lgamma(n / 2 + t + 1))))"
    return f"""{name}_b AS (SELECT id, p, n::DOUBLE AS n, 0.0::DOUBLE AS lo, (n + 20 * sqrt(2 * n) + 60)::DOUBLE AS hi, 0 AS step FROM ({ask})
UNION ALL SELECT id, p, n, CASE WHEN f < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < p THEN hi ELSE (lo + hi) / 2 END, step + 1 FROM (SELECT *, {series} AS f FROM {name}_b WHERE step < 60)),
{name} AS (SELECT id, p, n, (lo + hi) / 2 AS x FROM {name}_b WHERE step = 60)"""


def standardised(train: str, rows: str, columns: Sequence[str], keep: Sequence[str], scale: bool) -> str:
    """``k`` (training rows), ``s`` (means and scales), ``z`` (all rows, z0.. and ``keep``), ``zt`` (training rows), ``c1`` (covariances a_i_j)."""
    n = range(len(columns))
    s = ", ".join(f"avg({c}) AS m{i}, {f'stddev_samp({c})' if scale else '1.0'} AS s{i}" for i, c in enumerate(columns))
    z = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(columns))
    cov = ", ".join(f"covar_samp(z{i}, z{j}) AS {cell('a', i, j)}" for i, j in cells(len(n)))
    kept = "".join(f"{c}, " for c in keep)
    return f"k AS ({train}), s AS (SELECT count(*) AS n, {s} FROM k), z AS (SELECT {kept}{z} FROM ({rows}), s), zt AS (SELECT {z} FROM k, s), c1 AS (SELECT {cov} FROM zt)"


def axes(n: int, k: int) -> str:
    """``e``: projectors p<c>_i_j on the ``k`` main axes of ``c1`` one by one, and their variances l<c>."""
    parts, full = [], range(n)
    for c in range(1, k + 1):
        trace = " + ".join(f"a_{i}_{i}" for i in full)
        first = ", ".join(f"{cell('a', i, j)} / ({trace}) AS {cell('a', i, j)}" for i, j in cells(n))
        norm = " + ".join(f"{cell('a', i, j)} * {cell('a', i, j)}" for i in full for j in full)
        square = ", ".join("(" + " + ".join(f"{cell('a', i, m)} * {cell('a', m, j)}" for m in full) + f") / t AS {cell('a', i, j)}" for i, j in cells(n))
        parts.append(f"w{c} AS (SELECT 0 AS step, {first} FROM c{c} UNION ALL SELECT step + 1, {square} FROM (SELECT *, {norm} AS t FROM w{c} WHERE step < {STEPS})), p{c} AS (SELECT * FROM w{c} WHERE step = {STEPS})")
        along = " + ".join(f"c{c}.{cell('a', i, j)} * p{c}.{cell('a', i, j)}" for i in full for j in full)
        parts.append(f"l{c} AS (SELECT {along} AS l FROM c{c}, p{c})")
        parts.append(f"c{c + 1} AS (SELECT " + ", ".join(f"c{c}.{cell('a', i, j)} - l * p{c}.{cell('a', i, j)} AS {cell('a', i, j)}" for i, j in cells(n)) + f" FROM c{c}, p{c}, l{c})")
    columns = ", ".join(f"p{c}.{cell('a', i, j)} AS {cell(f'p{c}', i, j)}" for c in range(1, k + 1) for i, j in cells(n))
    return ", ".join(parts) + f", e AS (SELECT {columns}, " + ", ".join(f"l{c}.l AS l{c}" for c in range(1, k + 1)) + " FROM " + ", ".join(f"p{c}, l{c}" for c in range(1, k + 1)) + ")"


def quadratic(name: str, n: int) -> str:
    """z' P z."""
    return "(" + " + ".join(f"{cell(name, i, j)} * z{i} * z{j}" for i in range(n) for j in range(n)) + ")"


def distances(n: int, k: int) -> str:
    """``hq`` (all rows) and ``ht`` (training rows) with h and q."""
    h = " + ".join(f"{quadratic(f'p{c}', n)} / l{c}" for c in range(1, k + 1))
    q = " + ".join(f"z{i} * z{i}" for i in range(n)) + " - " + " - ".join(quadratic(f"p{c}", n) for c in range(1, k + 1))
    return f"hq AS (SELECT z.*, {h} AS h, {q} AS q FROM z, e), ht AS (SELECT {h} AS h, {q} AS q FROM zt, e)"


def degrees(columns: Sequence[str], table: str = "ht") -> str:
    """``d``: n<u> and <u>0 of each column by its median and interquartile range.

    The ratio of range and median falls with the degrees, so a rounded number of degrees
    is found by comparing with the ratios half way between whole numbers.
    """
    ask = "SELECT 10 * i + j AS id, p, i / 2.0 AS n FROM (SELECT unnest(range(2, 202)) AS i), (VALUES (0, 0.25), (1, 0.5), (2, 0.75)) AS v(j, p)"
    out = [chi2("g", ask), "gr AS (SELECT n, max(x) FILTER (p = 0.5) AS mid, max(x) FILTER (p = 0.75) - max(x) FILTER (p = 0.25) AS width FROM g GROUP BY n)"]
    for u in columns:
        out.append(f"r{u} AS (SELECT quantile_cont({u}, 0.5) AS med, quantile_cont({u}, 0.75) - quantile_cont({u}, 0.25) AS iqr FROM {table})")
        out.append(f"n{u} AS (SELECT 1 + count(*) FILTER (n > 1 AND n <> floor(n) AND width / mid > iqr / med) AS n FROM gr, r{u})")
        out.append(f"d{u} AS (SELECT gr.n AS n{u}, 0.5 * gr.n * (med / mid + iqr / width) AS {u}0 FROM gr JOIN n{u} ON gr.n = n{u}.n, r{u})")
    return ", ".join(out) + ", d AS (SELECT * FROM " + ", ".join(f"d{u}" for u in columns) + ")"


def pca(train: str, rows: str, columns: Sequence[str], k: int, keep: Sequence[str] = (), scale: bool = True, cuts: str = "(0, 0.95), (1, 1 - 0.05)") -> str:
    """A model with limits: ``f`` has all rows with h, q and distance, ``x`` the quantiles of its law for ``cuts`` (id, p); p may use s.n."""
    ask = f"SELECT id, p, nh + nq AS n FROM (SELECT v.id, v.p FROM s, LATERAL (VALUES {cuts}) AS v(id, p)), d"
    n = len(columns)
    parts = [standardised(train, rows, columns, keep, scale), axes(n, k), distances(n, k), degrees("hq"), "f AS (SELECT hq.*, nh * h / h0 + nq * q / q0 AS distance FROM hq, d)", chi2("x", ask)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


#: The regular limit at 0.05, and the outlier limit at 0.01 for the training rows' number.
LIMITS = "(0, 0.95), (1, pow(0.99, 1.0 / s.n))"
CRIT, OUT = "(SELECT x FROM x WHERE id = 0)", "(SELECT x FROM x WHERE id = 1)"


def pls(train: str, rows: str, columns: Sequence[str], y: str, k: int, keep: Sequence[str] = (), scale: bool = True) -> list[str]:
    """PLS of one response by covariances: ``v`` has w<a>_i, r<a>_i, p<a>_i, q<a>, t<a> (variance of a score); ``z`` as in ``standardised``, with ``y``."""
    n = range(len(columns))
    out = [standardised(train, rows, columns, [*keep, f"{y} AS y"], scale)]
    means = ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(columns))
    out.append(f"zy AS (SELECT {means}, {y} AS y FROM k, s)")
    out.append("v0 AS (SELECT c1.*, y0, " + ", ".join(f"x{i}, x{i} AS left0_{i}" for i in n) + " FROM c1, (SELECT avg(y) AS y0, " + ", ".join(f"covar_samp(z{i}, y) AS x{i}" for i in n) + " FROM zy))")
    for a in range(1, k + 1):
        norm = " + ".join(f"left{a - 1}_{i} * left{a - 1}_{i}" for i in n)
        out.append(f"v{a}a AS (SELECT *, " + ", ".join(f"left{a - 1}_{i} / sqrt({norm}) AS w{a}_{i}" for i in n) + f" FROM v{a - 1})")
        back = lambda i: "".join(f" - r{b}_{i} * (" + " + ".join(f"p{b}_{j} * w{a}_{j}" for j in n) + ")" for b in range(1, a))  # noqa: B023, E731
        out.append(f"v{a}b AS (SELECT *, " + ", ".join(f"w{a}_{i}{back(i)} AS r{a}_{i}" for i in n) + f" FROM v{a}a)")
        out.append(f"v{a}c AS (SELECT *, " + " + ".join(f"r{a}_{i} * {cell('a', i, j)} * r{a}_{j}" for i in n for j in n) + f" AS t{a} FROM v{a}b)")
        loads = ", ".join("(" + " + ".join(f"{cell('a', i, j)} * r{a}_{j}" for j in n) + f") / t{a} AS p{a}_{i}" for i in n)
        out.append(f"v{a}d AS (SELECT *, {loads}, (" + " + ".join(f"x{i} * r{a}_{i}" for i in n) + f") / t{a} AS q{a} FROM v{a}c)")
        out.append(f"v{a} AS (SELECT *, " + ", ".join(f"left{a - 1}_{i} - p{a}_{i} * q{a} * t{a} AS left{a}_{i}" for i in n) + f" FROM v{a}d)")
    return out + [f"v AS (SELECT * FROM v{k})"]


def pls_limits(train: str, rows: str, columns: Sequence[str], y: str, k: int, keep: Sequence[str] = ()) -> str:
    """``f`` with f and g of all rows, ``x`` with the limits: 0 and 1 regular and outlier on x alone, 2 and 3 on x and y."""
    n = range(len(columns))
    score = lambda a: "(" + " + ".join(f"z{i} * r{a}_{i}" for i in n) + ")"
    h = " + ".join(f"{score(a)} * {score(a)} / t{a}" for a in range(1, k + 1))
    q = " + ".join(f"pow(z{i} - " + " - ".join(f"{score(a)} * p{a}_{i}" for a in range(1, k + 1)) + ", 2)" for i in n)
    r = "pow(y - y0 - " + " - ".join(f"{score(a)} * q{a}" for a in range(1, k + 1)) + ", 2)"
    kept = "".join(f"{c}, " for c in keep)
    ask = "SELECT v.* FROM s, d, LATERAL (VALUES (0, 0.95, nh + nq), (1, pow(0.99, 1.0 / s.n), nh + nq), (2, 0.95, nh + nq + nr), (3, pow(0.99, 1.0 / s.n), nh + nq + nr)) AS v(id, p, n)"
    parts = [*pls(train, rows, columns, y, k, keep), f"hq AS (SELECT {kept}{h} AS h, {q} AS q, {r} AS r FROM z, v)", f"ht AS (SELECT {h} AS h, {q} AS q, {r} AS r FROM zy, v)"]
    parts += [degrees("hqr"), f"f AS (SELECT {kept}nh * h / h0 + nq * q / q0 AS f, nh * h / h0 + nq * q / q0 + nr * r / r0 AS g FROM hq, d)", chi2("x", ask)]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def pls_importance(train: str, columns: Sequence[str], y: str, k: int) -> str:
    """(feature, vip)."""
    part = " + ".join(f"t{a} * q{a} * q{a}" for a in range(1, k + 1))
    own = lambda i: " + ".join(f"w{a}_{i} * w{a}_{i} * t{a} * q{a} * q{a}" for a in range(1, k + 1))
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(sqrt({len(columns)} * ({own(i)}) / ({part})), 6) + 0.0 AS vip FROM v" for i, c in enumerate(columns))
    return "WITH RECURSIVE " + ",\n".join(pls(train, train, columns, y, k, scale=False)) + "\n" + each


def plsda(train: str, columns: Sequence[str], label: str, classes: Sequence[str], k: int, keep: Sequence[str]) -> str:
    """``y``: all rows with predicted memberships y<class>, in as many dimensions as there are classes less one; ``d2`` their squared distances to the class centres."""
    n, m = range(len(columns)), range(len(classes))
    parts = [standardised(train, train, columns, [*keep, label], True)]
    links = ", ".join(f"covar_samp(z{i}, ({label} = '{c}')::INT) AS left0_{i}_{g}" for i in n for g, c in enumerate(classes))
    shares = ", ".join(f"avg(({label} = '{c}')::INT) AS share{g}" for g, c in enumerate(classes))
    parts.append("v0 AS (SELECT c1.*, x.*, " + ", ".join(f"left0_{i}_{g} AS x_{i}_{g}" for i in n for g in m) + f" FROM c1, (SELECT {links}, {shares} FROM z) AS x)")
    for a in range(1, k + 1):
        # The main direction of left left', squared until it is alone.
        trace = " + ".join(f"left{a - 1}_{i}_{g} * left{a - 1}_{i}_{g}" for i in n for g in m)
        first = ", ".join("(" + " + ".join(f"left{a - 1}_{i}_{g} * left{a - 1}_{j}_{g}" for g in m) + f") / ({trace}) AS {cell('b', i, j)}" for i, j in cells(len(columns)))
        norm = " + ".join(f"{cell('b', i, j)} * {cell('b', i, j)}" for i in n for j in n)
        square = ", ".join("(" + " + ".join(f"{cell('b', i, o)} * {cell('b', o, j)}" for o in n) + f") / t AS {cell('b', i, j)}" for i, j in cells(len(columns)))
        parts.append(f"u{a} AS (SELECT 0 AS step, {first} FROM v{a - 1} UNION ALL SELECT step + 1, {square} FROM (SELECT *, {norm} AS t FROM u{a} WHERE step < {STEPS}))")
        mix = lambda i: "(" + " + ".join(f"{cell('b', i, j)} * {1 / (2 + j)}" for j in n) + ")"
        size = " + ".join(f"{mix(i)} * {mix(i)}" for i in n)
        parts.append(f"v{a}a AS (SELECT v{a - 1}.*, " + ", ".join(f"{mix(i)} / sqrt({size}) AS w{a}_{i}" for i in n) + f" FROM v{a - 1}, u{a} WHERE step = {STEPS})")
        back = lambda i: "".join(f" - r{b}_{i} * (" + " + ".join(f"p{b}_{j} * w{a}_{j}" for j in n) + ")" for b in range(1, a))  # noqa: B023, E731
        parts.append(f"v{a}b AS (SELECT *, " + ", ".join(f"w{a}_{i}{back(i)} AS r{a}_{i}" for i in n) + f" FROM v{a}a)")
        parts.append(f"v{a}c AS (SELECT *, " + " + ".join(f"r{a}_{i} * {cell('a', i, j)} * r{a}_{j}" for i in n for j in n) + f" AS t{a} FROM v{a}b)")
        loads = ", ".join("(" + " + ".join(f"{cell('a', i, j)} * r{a}_{j}" for j in n) + f") / t{a} AS p{a}_{i}" for i in n)
        inner = ", ".join("(" + " + ".join(f"x_{i}_{g} * r{a}_{i}" for i in n) + f") / t{a} AS q{a}_{g}" for g in m)
        parts.append(f"v{a}d AS (SELECT *, {loads}, {inner} FROM v{a}c)")
        parts.append(f"v{a} AS (SELECT *, " + ", ".join(f"left{a - 1}_{i}_{g} - p{a}_{i} * q{a}_{g} * t{a} AS left{a}_{i}_{g}" for i in n for g in m) + f" FROM v{a}d)")
    score = lambda a: "(" + " + ".join(f"z{i} * r{a}_{i}" for i in n) + ")"
    guess = ", ".join(f"share{g} + " + " + ".join(f"{score(a)} * q{a}_{g}" for a in range(1, k + 1)) + f" AS y{g}" for g in m)
    parts.append(f"y AS (SELECT {', '.join(keep)}, {label}, {guess} FROM z, v{k})")
    # Three classes: two dimensions, the second moments about a class's corner inverted outright.
    moment = ", ".join(f"avg((y{i} - {int(i == g)}) * (y{j} - {int(j == g)})) FILTER ({label} = '{c}') AS {cell(f's{g}', i, j)}" for g, c in enumerate(classes) for i, j in cells(2))
    d2 = ", ".join(
        f"(pow(y0 - {int(g == 0)}, 2) * s{g}_1_1 - 2 * (y0 - {int(g == 0)}) * (y1 - {int(g == 1)}) * s{g}_0_1 + pow(y1 - {int(g == 1)}, 2) * s{g}_0_0) / (s{g}_0_0 * s{g}_1_1 - s{g}_0_1 * s{g}_0_1) AS d2_{g}" for g in m
    )
    parts.append(f"d2 AS (SELECT y.*, {d2} FROM y, (SELECT {moment} FROM y))")
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
