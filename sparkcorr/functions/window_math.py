"""Column expressions over windows and pairs. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONST_STD, SPIKE_KURTOSIS = 1e-3, 5.0


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("double"), lambda s, x: s + x)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def safe_div(a: Column, b: Column) -> Column:
    """Null where a part is null or NaN, or the divisor 0."""
    return F.when(~F.isnan(a) & ~F.isnan(b) & (b != 0), F.try_divide(a, b))


def var_sum(n: int, s1: Column, s2: Column) -> Column:
    return s2 - s1 * s1 / F.lit(float(n))


def near_constant(n: int, s1: Column, s2: Column) -> Column:
    return var_sum(n, s1, s2) <= F.lit(CONST_STD**2 * n)


def excess_kurtosis(n: int, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """From raw moments, of the population; null for a constant window."""
    m1, m2, m3, m4 = (s / F.lit(float(n)) for s in (s1, s2, s3, s4))
    variance = m2 - m1 * m1
    fourth = m4 - F.lit(4.0) * m1 * m3 + F.lit(6.0) * m1 * m1 * m2 - F.lit(3.0) * m1 * m1 * m1 * m1
    return safe_div(fourth, variance * variance) - F.lit(3.0)


def spiked(n: int, *sums: Column) -> Column:
    return F.lit(False) if n < 4 else F.coalesce(excess_kurtosis(n, *sums) > F.lit(SPIKE_KURTOSIS), F.lit(False))


def pearson(n: int, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column) -> Column:
    """Clamped to [-1, 1]; null if a side is constant."""
    scale = F.sqrt(F.greatest(var_sum(n, sx, sxx) * var_sum(n, sy, syy), F.lit(0).cast("double")))
    r = safe_div(sxy - sx * sy / F.lit(float(n)), scale)
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def passes(r: Column, threshold: float, neg_corr: bool) -> Column:
    return F.coalesce((F.abs(r) if neg_corr else r) >= F.lit(float(threshold)), F.lit(False))


def episode_sign(r: Column) -> Column:
    """Sign while monitoring: 0 counts as positive."""
    return F.when(r >= 0, 1).otherwise(-1)


def metric_sign(r: Column) -> Column:
    """Sign in accuracy metrics: 0 counts as negative."""
    return F.when(r > 0, 1).otherwise(-1)


def canonical_pair(id1: Column, t1: Column, id2: Column, t2: Column) -> list[Column]:
    """id1, t1, id2, t2 with t1 >= t2; ids in order where times are equal."""
    swap = (t1 < t2) | ((t1 == t2) & (id1 > id2))
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    return [pick(id1, id2).alias("id1"), pick(t1, t2).alias("t1"), pick(id2, id1).alias("id2"), pick(t2, t1).alias("t2")]


def metric_text(v: Column) -> Column:
    """A metric for people: nan, 0.0000, three digits and an exponent if tiny or huge, else four decimals."""
    size = F.abs(v)
    return F.when(v.isNull() | F.isnan(v), "nan").when(v == 0, "0.0000").when((size < 1e-4) | (size >= 1e4), F.format_string("%.3e", v)).otherwise(F.format_string("%.4f", v))
