"""Column functions on numbers, arrays and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))


def log_fold_change(ref: Column, alt: Column) -> Column:
    """log2(alt / (ref + 1e-6)); null where alt is not positive."""
    return F.when(alt > 0, F.log2(alt / (ref + F.lit(1e-6))))


def scale_coverage(value: Column, cov_scale: Column) -> Column:
    return value / F.pow(F.lit(2.0), cov_scale)


def squash(x: Column, power: float, threshold: float) -> Column:
    """x^power, with what exceeds the threshold replaced by the root of its excess."""
    y = F.pow(x, F.lit(power))
    return F.when(y > threshold, threshold + F.sqrt(F.greatest(y - threshold, F.lit(0.0)))).otherwise(y)


def unsquash(y: Column, power: float, threshold: float) -> Column:
    x = F.when(y > threshold, threshold + F.pow(y - threshold, F.lit(2.0))).otherwise(y)
    return F.pow(x, F.lit(1.0 / power))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: the product with 10^digits half away from zero, and what becomes zero keeps its sign."""
    scale = float(10**digits)
    y = F.round(x * scale, 0) / scale
    return F.when(F.isnan(y) | (F.abs(y) == float("inf")), x).when(y == 0, x * 0.0).otherwise(y)


def one_hot(x: Column, vocabulary: list, keep_null: bool = False) -> Column:
    """0/1 doubles in the order of the vocabulary; all zero for an unknown or null value, or all null for null if that is kept."""
    hot = [(x == F.lit(v)).cast("double") for v in vocabulary]
    return F.array(*(hot if keep_null else [F.coalesce(h, F.lit(0.0)) for h in hot]))


def pad_or_cut(rows: Column, n: int, width: int) -> Column:
    """Exactly n vectors: the first n, filled up with zeros."""
    zero = F.array_repeat(F.lit(0.0), width)
    return F.slice(F.concat(rows, F.array_repeat(zero, n)), 1, n)


def geometric_spacing(low: int, high: int, n: int, divisor: int) -> Column:
    """n integers from low to high in equal ratios, rounded to multiples of the divisor."""
    ratio = (high / low) ** (1 / (n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.bround(low * F.pow(F.lit(ratio), k) / divisor, 0) * divisor).cast("long"))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))
