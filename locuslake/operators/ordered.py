"""Whole tables in an order, without one task ever holding the order: ordinals, running sums, as-of joins, quantiles.

A table is cut into ranges of the order (parts), written to the shared folder so that they stay as they are. What has to
be known of the parts before one is a row for each part (or part and group), in number bounded by the shuffle's
partitions; the rest happens inside parts, which are tasks of about equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.sources.store import park

#: monotonically_increasing_id has the partition above these bits and the place in it below.
PLACE_BITS = 33


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parted(rows: DataFrame, order: list) -> DataFrame:
    """rows with `_part` and `_place`: ranges of the order that follow each other, and 0, 1, ... in each of them.

    Rows equal in the whole order share a part: end the order with a column that tells them apart.
    """
    kept = rows.repartitionByRange(_partitions(rows), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = park(kept, "parted")
    return kept.withColumns({"_part": F.shiftright("_id", PLACE_BITS), "_place": F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)}).drop("_id")


def _before(sums: DataFrame, group: list[str], n: str) -> DataFrame:
    """sums (one row for each part and group) with the sum of n over the parts before, as `_start`."""
    earlier = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_start", F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def ordinals(rows: DataFrame, order: list, out: str = "ordinal") -> DataFrame:
    """rows numbered from 0 without gaps in the order."""
    cut = parted(rows, order)
    starts = _before(cut.groupBy("_part").agg(F.count("*").alias("_n")), [], "_n").select("_part", "_start")
    return cut.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")  # a row for each part


def running(rows: DataFrame, group: list[str], order: list[str], n: str, before: str = "before", total: str = "total") -> DataFrame:
    """rows with the sum of n over the rows before in the order of its group, and over the whole group.

    A group of any size is spread over the parts it reaches into; (group, order) should tell rows apart.
    """
    cut = parted(rows, [*group, *order])
    sums = _before(cut.groupBy("_part", *group).agg(F.sum(n).alias("_n")), group, "_n").withColumn("_all", F.sum("_n").over(W.partitionBy(*group)))
    sums = sums.select("_part", "_start", "_all", *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)])
    inside = W.partitionBy("_part", *group).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    kept = cut.withColumn("_own", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    # a row for each part and group
    joined = kept.alias("a").join(sums.withColumnRenamed("_part", "_p"), (F.col("a._part") == F.col("_p")) & _same(group))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("_start") + F.col("_own")).alias(before), F.col("_all").alias(total))


def _same(group: list[str]) -> Column:
    out = F.lit(True)
    for k, c in enumerate(group):
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"_g{k}"))
    return out


def asof(points: DataFrame, marks: DataFrame, group: list[str], at: str, value: list[str], strict: bool = False) -> DataFrame:
    """points with the values of the last mark of their group at or before them (strict: before them); null if none is.

    Both sides have the columns `group` and `at`. They are put into one order and cut into parts; a part's last mark is
    carried to the points of the parts after it that come before their own first mark. Of marks at one place the one
    with the greatest values is the last. Points at one place are told apart by a hash, so that many of them make no
    long part.
    """
    keys = [*group, at]
    mark = marks.select(*keys, F.struct(*value).alias("_value"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_point"))
    own = points.select(*keys, F.lit(None).cast(mark.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_point"))
    side = F.when(F.col("_point").isNull(), 1 if strict else 0).otherwise(0 if strict else 1)
    both = mark.unionByName(own).withColumn("_side", side).withColumn("_spread", F.when(F.col("_point").isNotNull(), F.xxhash64("_point")))
    cut = parted(both, [*keys, "_side", "_value", "_spread"])
    group_key = F.struct(*group) if group else F.lit(1)
    here = W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    seen = F.when(F.col("_value").isNotNull(), F.struct(group_key.alias("g"), F.col("_value").alias("v")))
    filled = cut.withColumn("_last", F.last(seen, ignorenulls=True).over(here)).filter("_point is not null")
    ends = cut.withColumn("_seen", seen).groupBy("_part").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("_place"))).alias("_end"))
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", "_carry")
    found = filled.join(F.broadcast(carried), "_part").withColumn("_hit", F.coalesce("_last", "_carry"))  # a row for each part
    own_key = F.struct(*[F.col(f"_point.{c}") for c in group]) if group else F.lit(1)
    hit = F.when(F.col("_hit.g").eqNullSafe(own_key), F.col("_hit.v"))
    return found.select("_point.*", hit.alias("_hit")).select(*[F.col(c) for c in points.columns], *[F.col(f"_hit.{c}").alias(c) for c in value])


def quantiles(rows: DataFrame, group: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """(group, q0, q1, ...): exact quantiles, interpolated between the two ranks around p * (n - 1).

    Equal values are counted first; then the wanted ranks are looked up where the running counts reach them. Nulls
    don't count. Without a group it is one row, null for an empty table.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = running(counted, group, ["_v"], "_c", "_before", "_total")
    out = []
    for k, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        at = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_c")), F.col("_v")))  # noqa: B023, E731
        out += [at(F.floor(rank)).alias(f"_lo{k}"), at(F.ceil(rank)).alias(f"_hi{k}"), F.max(rank - F.floor(rank)).alias(f"_f{k}")]
    picked = placed.groupBy(*group).agg(*out)
    between = lambda k: F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_f{k}")
    return picked.select(*group, *[between(k).alias(f"q{k}") for k in range(len(probabilities))])
