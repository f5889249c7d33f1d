"""Assertions and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most rows of a table that is broadcast where its size is not bounded by what it holds.
MAX_BROADCAST = 500_000


def small(rows: DataFrame, n: int | None = None, most: int = MAX_BROADCAST) -> DataFrame:
    """rows marked for broadcast if there are at most `most` of them, else as they are, for joins by shuffle.

    n: their number, or of their array entries, if known; else they are counted, as far as `most`.
    """
    return F.broadcast(rows) if (rows.limit(most + 1).count() if n is None else n) <= most else rows


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with n."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    found = duplicates(rows, key).limit(5).collect()
    if found:
        raise ValueError(f"repeated keys: {[tuple(r) for r in found]}")
    return rows


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b, key, "left_anti").isEmpty() and b.join(a, key, "left_anti").isEmpty()


def union(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """All rows of named frames with the name as a column; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def unfinished(wanted: DataFrame, done: DataFrame, key: list[str], alleles: int | None = None) -> DataFrame:
    """Wanted rows that are not done; with alleles, a key is done if all of its alleles are."""
    if alleles is not None:
        done = done.groupBy(*key).agg(F.countDistinct("allele").alias("_n")).filter(F.col("_n") >= alleles)
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def require_folds(rows: DataFrame, fold: str, least: int = 1, warn: int = 10) -> DataFrame:
    """(fold, n, few): counts per fold; a fold under `least` is an error, one under `warn` is marked."""
    counts = rows.groupBy(fold).agg(F.count("*").alias("n"))
    bad = counts.filter(F.col("n") < least).limit(1).collect()
    if bad or counts.isEmpty():
        raise ValueError(f"too few rows in a fold: {bad}")
    return counts.withColumn("few", F.col("n") < warn)


def require_columns(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows, if they have the named columns with the named types (a type may start with the name given)."""
    found = dict(rows.dtypes)
    wrong = {c: found.get(c, "missing") for c, kind in kinds.items() if not found.get(c, "missing").startswith(kind)}
    if wrong:
        raise ValueError(f"columns of another kind than asked for: {wrong}")
    return rows


def merge_config(defaults: dict, given: dict) -> dict:
    """defaults with the values given; a name that has no default is an error, and so is a default of REQUIRED that is not given."""
    unknown = sorted(set(given) - set(defaults))
    out = {**defaults, **given}
    absent = sorted(k for k, v in out.items() if v is REQUIRED)
    if unknown or absent:
        raise ValueError(f"unknown settings {unknown}, missing settings {absent}")
    return out


#: A setting without a default.
REQUIRED = object()
