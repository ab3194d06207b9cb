"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson score interval, clamped to [0, 1]; (0, 1) where n is 0."""
    s, m = successes.cast("double"), n.cast("double")
    p = F.try_divide(s, m)
    d = 1 + F.try_divide(F.lit(z * z), m)
    centre = (p + F.try_divide(F.lit(z * z), 2 * m)) / d
    half = z / d * F.sqrt(F.try_divide(p * (1 - p), m) + F.try_divide(F.lit(z * z), 4 * m * m))
    low = F.when(m > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(0.0)
    high = F.when(m > 0, F.least(F.lit(1.0), centre + half)).otherwise(1.0)
    return low, high


def wilson_sql(s: str, n: str, z: float = Z) -> tuple[str, str]:
    z2 = z * z
    centre = f"(({s})::DOUBLE / ({n}) + {z2} / (2.0 * ({n}))) / (1 + {z2} / ({n}))"
    half = f"{z} / (1 + {z2} / ({n})) * sqrt((({s})::DOUBLE / ({n})) * (1 - ({s})::DOUBLE / ({n})) / ({n}) + {z2} / (4.0 * ({n}) * ({n})))"
    return f"CASE WHEN ({n}) > 0 THEN greatest(0.0::DOUBLE, {centre} - {half}) ELSE 0.0::DOUBLE END", f"CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE, {centre} + {half}) ELSE 1.0::DOUBLE END"


def exclusive_quantile(values: Column, k: int, n: int) -> Column:
    """The k-th of n-quantiles by the exclusive method: interpolation at rank k (m + 1) / n; values: a sorted array of at least two."""
    m = F.size(values)
    at = (m + 1) * k
    j = F.greatest(F.lit(1), F.least(m - 1, F.floor(at / n).cast("int")))
    part = (at - j * n) / F.lit(float(n))
    low, high = F.get(values, j - 1), F.get(values, j)
    return low * (1 - part) + high * part


def nearest_rank(values: Column, q: float) -> Column:
    """values[round(q (m - 1))], rounding half to even; values: a sorted array. Null where it is empty."""
    return F.get(values, F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int"))


def entropy_term(p: Column) -> Column:
    """-p log2 p, 0 at 0."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for null, empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0))).otherwise(0.0)


def resampled(histogram: Column, bins: int) -> Column:
    """A histogram (array of shares over one interval) with so many bins: what its cumulative shares, linear within a bin, gain from edge to edge, in all 1. As it is where it has that many bins; zeros where it holds nothing."""
    size = F.size(histogram)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def upto(edge: Column) -> Column:
        at = edge * size / F.lit(float(bins))
        whole = F.floor(at).cast("int")
        return total(F.slice(histogram, F.lit(1), whole)) + (at - whole) * F.coalesce(F.get(histogram, whole), F.lit(0.0))

    gains = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda k: F.greatest(F.lit(0.0), upto(k) - upto(k - 1)))
    scaled = F.transform(gains, lambda x: x / total(gains))
    zeros = F.array_repeat(F.lit(0.0), bins)
    return F.when(size == bins, histogram).when(histogram.isNull() | (size == 0) | (total(histogram) <= 0), zeros).otherwise(scaled)


def divergence(p: Column, q: Column, least: float = 1e-9) -> Column:
    """Kullback-Leibler divergence of two histograms of as many bins, shares under least counting as least; not below 0."""
    floor = lambda x: F.greatest(x, F.lit(least))
    return F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda a, b: floor(a) * F.ln(floor(a) / floor(b))), F.lit(0.0), lambda s, x: s + x))
