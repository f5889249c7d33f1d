"""Orders, samples and batches that depend on keys and a seed alone, never on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.sources.store import park


def hash_order(key: Column, seed: int = 0) -> Column:
    """md5 of key|seed: the same order in any engine."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from keys and seed."""
    return (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11) + 0.5) / float(1 << 53)


def even(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from keys and seed, the same in any engine: the first 13 hex digits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / float(1 << 52)


def shuffle(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """rows in hash order of the key, the same for a seed wherever it is run."""
    return rows.orderBy(hash_order(F.col(key), seed), key)


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 0, group: str | None = None) -> DataFrame:
    """n rows, or n of each group, by hash order."""
    order = [hash_order(F.col(key), seed), F.col(key)]
    if group is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def sample_fraction(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Rows whose key's hash falls below the fraction."""
    return rows.filter(uniform(seed, F.col(key)) < fraction)


def sample_with_replacement(rows: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """rows, each as often as a Poisson draw of mean `fraction` from its key says."""
    edges, term = [], math.exp(-fraction)
    while 1 - sum(edges[-1:]) > 1e-15 and len(edges) < 200:
        edges.append(sum(edges[-1:]) + term)
        term *= fraction / len(edges)
    times = F.size(F.filter(F.array(*[F.lit(x) for x in edges]), lambda x: x <= even(seed, F.col(key))))
    return rows.withColumn("_times", times).filter("_times > 0").withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def weighted_sample(rows: DataFrame, group: str, key: str, weight: str, n: int, seed: int = 0, skip: DataFrame | None = None) -> DataFrame:
    """n rows of each group without replacement, likelier by weight (exponential keys); fewer candidates are an error."""
    pool = rows if skip is None else rows.join(skip.select(key), key, "left_anti")
    short = pool.filter(F.col(weight) > 0).groupBy(group).agg(F.count("*").alias("c")).filter(F.col("c") < n)
    if not short.isEmpty():
        raise ValueError(f"a group has fewer than {n} candidates")
    order = -F.log(even(seed, F.col(group), F.col(key))) / F.col(weight)
    w = W.partitionBy(group).orderBy(order, key)
    return pool.filter(F.col(weight) > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def every_nth(rows: DataFrame, order: list[str], n: int, offset: int = 0) -> DataFrame:
    """Every n-th row of the ordered table from an offset on. Ranks are found without a single sorted partition:
    rows are range partitioned, and each partition's rows are numbered from the counts of those before. The dealt rows
    are written to the shared folder, since a second dealing, after a lost executor, may cut the ranges elsewhere."""
    ordered = park(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = {r["_p"]: r["c"] for r in ordered.groupBy("_p").agg(F.count("*").alias("c")).collect()}
    before, run = {}, 0
    for p in sorted(counts):
        before[p] = run
        run += counts[p]
    if not before:
        return rows
    start = F.create_map([F.lit(x) for kv in before.items() for x in kv])[F.col("_p")]
    local = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return ordered.withColumn("_i", start + local).filter(F.pmod(F.col("_i") - offset, F.lit(n)) == 0).drop("_p", "_i")


def take(rows: DataFrame, order: list, n: int, skip: int = 0) -> DataFrame:
    """n rows after the first `skip` of a total order."""
    return rows.orderBy(*order).offset(skip).limit(n)


def top_by_std(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, std): the n groups of the largest sample deviation, the smallest name on ties."""
    s = rows.groupBy(group).agg(F.round(F.stddev_samp(value), 6).alias("std")).filter("std is not null")
    return s.orderBy(F.desc("std"), group).limit(n)


def top_by_dispersion(rows: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """(group, dispersion): the n groups of the largest variance over mean."""
    s = rows.groupBy(group).agg(F.round(F.try_divide(F.var_samp(value), F.avg(value)), 6).alias("dispersion")).filter("dispersion is not null")
    return s.orderBy(F.desc("dispersion"), group).limit(n)


def best_k(rows: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """Rows of rank k or better in their group, ties included."""
    return rows.withColumn("rank", F.rank().over(W.partitionBy(group).orderBy(F.desc(score)))).filter(F.col("rank") <= k)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in an explicit order."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def batches(rows: DataFrame, order: list, size: int, group: str, drop_last: bool = True) -> DataFrame:
    """rows with batch number within each group; the last batch goes if it is not full."""
    w = W.partitionBy(group)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w.orderBy(*order)) - 1) / size))
    if drop_last:
        out = out.withColumn("_n", F.count("*").over(W.partitionBy(group, "batch"))).filter(F.col("_n") == size).drop("_n")
    return out


def with_low_share(rows: DataFrame, key: str, value: str, low: float, high: float, ratio: float, seed: int = 0) -> DataFrame:
    """Rows with low < value < high, and of those at or below low as many, by hash order, as ratio times them; one at least."""
    good = rows.filter((F.col(value) > low) & (F.col(value) < high))
    n = max(1, int(good.count() * ratio))
    return good.unionByName(rows.filter(F.col(value) <= low).orderBy(hash_order(F.col(key), seed), key).limit(n))


def transition_map(transition: DataFrame, seed: int = 0) -> DataFrame:
    """(src_id, dst_id): for each source one target by its probability: the first whose running sum exceeds a hash's share."""
    w = W.partitionBy("src_cond", "dst_cond", "src_id").orderBy("dst_id").rowsBetween(W.unboundedPreceding, 0)
    t = transition.withColumn("_cdf", F.sum("p").over(w)).withColumn("_u", even(seed, F.col("src_cond"), F.col("dst_cond"), F.col("src_id")))
    total = W.partitionBy("src_cond", "dst_cond", "src_id")
    t = t.withColumn("_u", F.col("_u") * F.sum("p").over(total)).filter(F.col("_cdf") > F.col("_u"))
    return t.groupBy("src_cond", "dst_cond", "src_id").agg(F.min_by("dst_id", F.struct("_cdf", "dst_id")).alias("dst_id"))
