"""Functions of series as Catalyst expressions: array in, array or number out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    """A sum with compensation for what single additions lose."""

    def add(a: Column, v: Column) -> Column:
        t = a["s"] + v
        lost = F.when(F.abs(a["s"]) >= F.abs(v), (a["s"] - t) + v).otherwise((v - t) + a["s"])
        return F.struct(t.alias("s"), (a["c"] + lost).alias("c"))

    return F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), add, lambda a: a["s"] + a["c"])


def once(value: Column, f) -> Column:
    """f(value) with value computed once a row, however often f uses it: within a lambda it would be computed for each point."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def _squares(x: Column, m: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))


def sample_sd(x: Column) -> Column:
    return once(mean(x), lambda m: F.sqrt(_squares(x, m) / (F.size(x) - 1)))


def l2norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def zscore(x: Column, center: bool = True, scale: bool = True) -> Column:
    """(x - mean) / sample deviation; a constant series gives zeros. Without centering, the scale is the root mean square over n - 1."""

    def scaled(m: Column) -> Column:
        s = F.sqrt(_squares(x, m) / (F.size(x) - 1)) if scale else F.lit(1.0)
        return once(s, lambda s: F.transform(x, lambda v: F.when((s > 0) & ~F.isnan(s), (v - m) / s).otherwise(F.lit(0.0))))

    return once(mean(x) if center else F.lit(0.0), scaled)


def zscore_parameters(x: Column, center: bool = True, scale: bool = True) -> Column:
    """What zscore() subtracts and divides by, as a struct (center, scale)."""
    return once(mean(x) if center else F.lit(0.0), lambda m: F.struct(m.alias("center"), (F.sqrt(_squares(x, m) / (F.size(x) - 1)) if scale else F.lit(1.0)).alias("scale")))


def by_variable(x: Column, n_vars: int, f) -> Column:
    """f of each variable of a multivariate series by itself."""
    one = lambda k: F.transform(x, lambda r: r[k])
    cols = [f(one(k)) for k in range(n_vars)]
    return F.transform(F.arrays_zip(*[c.alias(f"v{k}") for k, c in enumerate(cols)]), lambda z: F.array(*[z[f"v{k}"] for k in range(n_vars)]))


def reinterpolate(x: Column, length: int) -> Column:
    """Linear interpolation at `length` equally spaced points from the first to the last."""

    def at(k: Column) -> Column:
        pos = k * (F.size(x) - 1) / F.lit(float(max(length - 1, 1)))
        low = F.least(F.floor(pos).cast("int"), F.size(x) - 1)
        high = F.least(low + 1, F.size(x) - 1)
        return F.get(x, low) + (pos - low) * (F.get(x, high) - F.get(x, low))

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def envelope(x: Column, window: int) -> tuple[Column, Column]:
    """Least and greatest value within `window` points to either side: extremes of spans of 1, 2, 4.. points, each from two of the half, and at last two spans that overlap; log2(window) passes over a
    series. Where a span goes over an end, what isn't there is null, which least and greatest leave out."""
    wide = 2 * window + 1
    padded = F.concat(F.array_repeat(F.lit(None).cast("double"), window), x)

    def spans(values: Column, size: int, pick) -> Column:
        ahead = lambda v, by: F.zip_with(v, F.slice(v, by + 1, F.size(v)), pick)
        if 2 * size <= wide:
            return once(ahead(values, size), lambda v: spans(v, 2 * size, pick))
        return ahead(values, wide - size) if wide > size else values

    return tuple(F.slice(spans(padded, 1, pick), 1, F.size(x)) for pick in (lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)))


def acf(x: Column, lags: int) -> Column:
    """Autocorrelation at lags 0..lags; of a constant series 1 and zeros."""

    def of(dev: Column) -> Column:
        lagged = lambda k: total(F.zip_with(F.slice(dev, F.lit(1), F.greatest(F.size(dev) - k, F.lit(0))), F.slice(dev, k + 1, F.greatest(F.size(dev) - k, F.lit(0))), lambda a, b: a * b))
        ratio = lambda k, power: F.when(power > 0, lagged(k) / power).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
        return once(lagged(F.lit(0)), lambda power: F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: ratio(k, power)))

    return once(mean(x), lambda m: once(F.transform(x, lambda v: v - m), of))


def minkowski(x: Column, y: Column, p: int) -> Column:
    """L1 or L2 distance of equal lengths."""
    if p == 1:
        return F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))


def excess(x: Column, lower: Column, upper: Column) -> Column:
    """How far each point lies outside an envelope."""
    return F.zip_with(x, F.arrays_zip(lower.alias("l"), upper.alias("u")), lambda v, e: F.greatest(v - e["u"], e["l"] - v, F.lit(0.0)))


def clamp(x: Column, lower: Column, upper: Column) -> Column:
    return F.zip_with(x, F.arrays_zip(lower.alias("l"), upper.alias("u")), lambda v, e: F.least(F.greatest(v, e["l"]), e["u"]))


def norm_sum(parts: Column, norm: str) -> Column:
    return total(parts) if norm == "L1" else l2norm(parts)


def shift_dot(x: Column, y: Column, lag: Column) -> Column:
    """Sum of x[t + lag] y[t] over the overlap."""
    n = F.least(F.size(x) - F.greatest(lag, F.lit(0)), F.size(y) + F.least(lag, F.lit(0)))
    return total(F.zip_with(F.slice(x, F.greatest(lag, F.lit(0)) + 1, n), F.slice(y, F.greatest(-lag, F.lit(0)) + 1, n), lambda a, b: a * b))


def nccc(x: Column, y: Column) -> Column:
    """Cross-correlation at lags -(ny - 1)..nx - 1 over the product of the norms; infinite if that is 0."""
    at = lambda norm: F.transform(F.sequence(1 - F.size(y), F.size(x) - 1), lambda k: F.when(norm > 0, shift_dot(x, y, k) / norm).otherwise(F.lit(float("inf"))))
    return once(l2norm(x) * l2norm(y), at)


def sbd_expression(x: Column, y: Column) -> Column:
    """Shape-based distance of short series; 1 if either has norm 0."""
    return F.when(l2norm(x) * l2norm(y) > 0, 1 - F.array_max(nccc(x, y))).otherwise(F.lit(1.0))
