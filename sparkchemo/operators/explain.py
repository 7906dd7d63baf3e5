"""Small arithmetic around trained networks: activation maps, schedules, class weights. Training is not done here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkchemo.operators.spectra import _let


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): rows / (classes * rows of the class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    return n.select(label, (F.lit(total["rows"]) / (F.col("n") * F.lit(max(1, total["classes"])))).alias("weight"))


def encode_labels(df: DataFrame, label: str, to: str = "code") -> DataFrame:
    """``df`` with the place of its label among the sorted labels; the labels are few and join back."""
    labels = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)
    code = F.lit(None).cast("int")
    for i, v in enumerate(labels):
        code = F.when(F.col(label) == v, F.lit(i)).otherwise(code)
    return df.withColumn(to, code)


def cyclical_rate(step: Column, base: float, top: float, half: int, kind: str = "triangular", gamma: float = 0.9994) -> Column:
    """A learning rate that rises and falls: plain, halved every cycle ('triangular2') or decaying ('exp_range')."""
    cycle = F.floor(1 + step / (2 * half))
    x = F.abs(step / half - 2 * cycle + 1)
    size = {"triangular": F.lit(1.0), "triangular2": 1 / F.pow(F.lit(2.0), cycle - 1), "exp_range": F.pow(F.lit(gamma), step)}[kind]
    return F.lit(base) + (top - base) * F.greatest(F.lit(0.0), 1 - x) * size


def smoothed_losses(losses: Column, beta: float = 0.98) -> Column:
    """Bias-corrected running means of an array of losses."""
    none = F.array().cast("array<double>")
    start = F.struct(F.lit(0.0).alias("m"), none.alias("out"))
    step = lambda a, v: F.struct((beta * a["m"] + (1 - beta) * v).alias("m"), F.concat(a["out"], F.array(beta * a["m"] + (1 - beta) * v)).alias("out"))
    raw = F.aggregate(losses, start, step, lambda a: a["out"])
    return F.transform(raw, lambda v, i: v / (1 - F.pow(F.lit(beta), i + 1)))


def _relevance(activation: Column, gradient: Column, elementwise: bool) -> Column:
    """The signed relevance of each place of arrays [place][channel]."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    if elementwise:
        return F.zip_with(activation, gradient, dot)

    def means(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(g[0]) - 1), lambda c: F.aggregate(g, F.lit(0.0), lambda s, row: s + F.get(row, c)) / F.size(g))

    # Named once: a lambda works out anew, for each element, what it reads from outside.
    return _let(gradient, lambda g: _let(means(g), lambda mean: F.transform(activation, lambda row: dot(row, mean))))


def activation_map(activation: Column, gradient: Column, elementwise: bool = False) -> Column:
    """Relevance by place from arrays [place][channel]: channels weighted by their mean gradient, or entry by entry."""
    rise = F.transform(_relevance(activation, gradient, elementwise), lambda v: F.greatest(v, F.lit(0.0)))
    return _let(rise, lambda up: _let(F.array_max(up), lambda top: F.transform(up, lambda v: F.try_divide(v, top))))


def activation_map_2d(activation: Column, gradient: Column, elementwise: bool = True, symmetric: bool = True) -> Column:
    """[row][column] relevance in [0, 1] of an image from arrays [row][column][channel]; null where nothing speaks for the class.

    With ``symmetric`` (square maps), entries (i, j) and (j, i) are averaged before negative ones become 0, so what
    speaks against the class on one side counts on the other.
    """

    def whole(flat: Column, height: Column, width: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.slice(flat, i * width + 1, width))
        if symmetric:
            at = lambda i, j: F.get(flat, i * width + j)
            places = F.sequence(F.lit(0), width - 1)
            rows = F.transform(places, lambda i: F.transform(places, lambda j: (at(i, j) + at(j, i)) / 2))
        return _let(F.transform(rows, lambda row: F.transform(row, lambda v: F.greatest(v, F.lit(0.0)))), lambda up: _let(F.array_max(F.flatten(up)), lambda top: F.transform(up, lambda row: F.transform(row, lambda v: F.try_divide(v, top)))))

    return _let(activation, lambda a: _let(_relevance(F.flatten(a), F.flatten(gradient), elementwise), lambda flat: whole(flat, F.size(a), F.size(a[0]))))


def condense(image: Column, how: str = "mean") -> Column:
    """One importance for each column of an image [row][column]: the mean or the max of its entries."""
    if how not in ("mean", "max"):
        raise ValueError("how is 'mean' or 'max'")
    column = lambda j: F.transform(image, lambda row: F.get(row, j))
    one = (lambda v: F.array_max(v)) if how == "max" else (lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))
    return F.transform(F.sequence(F.lit(0), F.size(image[0]) - 1), lambda j: one(column(j)))


def _weights(i: Column, size: Column, n: int) -> Column:
    """(place, weight) of the places of an array of ``size`` that make place ``i`` of ``n``: a triangle about its centre."""
    scale = size / F.lit(float(n))
    center, reach = (i + 0.5) * scale, F.greatest(F.lit(1.0), scale)
    first, last = F.greatest(F.lit(0), F.floor(center - reach + 0.5).cast("int")), F.least(size, F.floor(center + reach + 0.5).cast("int")) - 1
    return F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("k"), F.greatest(F.lit(0.0), 1 - F.abs(k + 0.5 - center) / reach).alias("w")))


def _blend(weights: Column, value) -> Column:
    """The weighted mean of ``value`` of the places."""
    sums = F.aggregate(weights, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, p: F.struct((a["s"] + p["w"] * value(p["k"])).alias("s"), (a["w"] + p["w"]).alias("w")))
    return _let(sums, lambda a: a["s"] / a["w"])


def resize_image(image: Column, rows: int, columns: int) -> Column:
    """An image [row][column] stretched or shrunk to ``rows`` by ``columns`` by bilinear interpolation between the pixels' centres.

    Shrinking averages over all pixels that a new one covers, by a triangle; edges are held.
    """
    wide = F.transform(image, lambda row: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: _blend(_weights(j, F.size(row), columns), lambda k: F.get(row, k))))

    def high(part: Column) -> Column:
        pixel = lambda i, j: _blend(_weights(i, F.size(part), rows), lambda k: F.get(F.get(part, k), j))
        return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: pixel(i, j)))

    return _let(wide, high)


def resample(x: Column, n: int) -> Column:
    """An array stretched to ``n`` places by linear interpolation."""

    def at(i: Column) -> Column:
        place = i * (F.size(x) - 1) / F.lit(float(max(1, n - 1)))
        low = F.floor(place).cast("int")
        a, b = F.get(x, low), F.get(x, F.least(low + 1, F.size(x) - 1))
        return a + (b - a) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def nearest(x: Column, n: int) -> Column:
    """An array stretched to ``n`` places by the nearest of its own."""
    place = lambda i: F.round(i * (F.size(x) - 1) / F.lit(float(max(1, n - 1)))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(x, place(i)))


def color_table(df: DataFrame, key: str, series: Column, importance: Column, n: int, interpolate: bool = True, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(key, i, value, color): a series of ``n`` places with its importances stretched over it and scaled to [0, 1].

    The scale is the importances' own range, or ``bounds``; equal ends give null.
    """
    up = (resample if interpolate else nearest)(importance, n)
    low, high = (F.array_min(importance), F.array_max(importance)) if bounds is None else (F.lit(float(bounds[0])), F.lit(float(bounds[1])))
    each = df.select(key, F.posexplode(F.arrays_zip(series.alias("value"), up.alias("up"))).alias("i", "z"), low.alias("_low"), high.alias("_high"))
    return each.select(key, "i", F.col("z.value").alias("value"), F.try_divide(F.col("z.up") - F.col("_low"), F.col("_high") - F.col("_low")).alias("color"))


def pick_rates(df: DataFrame, step: str, rate: str, loss: str, beta: float = 0.98, skip: int = 0, worse: float = 4.0) -> DataFrame:
    """(base, top) of a cyclical rate from a sweep of rising rates, one row a step: the sweep is one small array.

    Losses are smoothed; steps up to the first whose loss is ``worse`` times the least so far
    count. ``top`` is the rate of the least smoothed loss, ``base`` that of its steepest fall before it.
    """
    sweep = df.agg(F.array_sort(F.collect_list(F.struct(step, rate, loss))).alias("s"))
    smooth = sweep.select("s", smoothed_losses(F.transform("s", lambda r: r[loss].cast("double")), beta).alias("l"))
    rows = smooth.select(F.posexplode(F.arrays_zip(F.transform("s", lambda r: r[rate]).alias("rate"), F.col("l").alias("loss"))).alias("i", "z"), "l").where(F.col("i") >= skip)
    least = lambda i: F.array_min(F.slice("l", 1, i + 1))
    rows = rows.select("i", "z.rate", "z.loss", (F.col("z.loss") - F.get("l", F.col("i") - 1)).alias("fall"), (F.col("z.loss") > worse * least(F.col("i"))).alias("bad"))
    end = rows.agg(F.min(F.when(F.col("bad"), F.col("i"))).alias("end"))
    kept = rows.join(F.broadcast(end), F.col("end").isNull() | (F.col("i") < F.col("end")), "inner")
    top = kept.agg(F.min_by(F.struct("i", "rate"), F.struct("loss", "i")).alias("t"))
    down = kept.join(F.broadcast(top), F.col("i") <= F.col("t.i"))
    return down.agg(F.min_by("rate", F.struct(F.coalesce("fall", F.lit(0.0)), "i")).alias("base"), F.first("t.rate").alias("top"))
