"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a maximal run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or a new one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="locuslake-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def park(frame: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it again, which cuts its lineage there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/parked-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def named(column: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col(f"`{column.replace('`', '``')}`")


def row_hash(frame: DataFrame) -> Column:
    """A hash of a whole row; maps, which have no hash, count by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(named(f.name))) if "map<" in f.dataType.simpleString() else named(f.name) for f in frame.schema.fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus, the split that holds labels out; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def unit_hash(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


#: A key is hot if it holds more than this share of the rows; there are less than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def attach(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, salt: str) -> DataFrame:
    """rows with the columns of table, which has one row for each combination of keys that rows hold (none null).

    Column `count` of the table is how many of the `total` rows have the keys. The hot ones, 1000 at most, are
    broadcast, and rows that have one are spread by `salt`, a double in [0, 1), in the join with the others: no task
    gets a hot key's rows.
    """
    own = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*own).alias("_own"), (F.col(count) > HOT_SHARE * total).alias("_is_hot"))
    hot = F.broadcast(packed.filter("_is_hot").select(*keys, F.col("_own").alias("_hot")))
    # -1 in every row, but not as a constant: as that it would be no key of the join
    cold = packed.filter("not _is_hot").select(*keys, F.col("_own").alias("_cold"), F.least(F.col("_own")[count], F.lit(-1)).cast("long").alias("_salt"))
    flagged = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.floor(F.col(salt) * 4096)).otherwise(-1))
    found = flagged.join(cold, [*keys, "_salt"], "left").withColumn("_own", F.coalesce("_hot", "_cold"))
    return found.select(*map(named, rows.columns), *[F.col(f"_own.{c}").alias(c) for c in own])


def starts(counts: DataFrame, group: list[str], order: str, n: str, out: str, run: int = 64) -> DataFrame:
    """counts with `out`, the sum of `n` over the rows before in `order` (whole numbers from 0) of its group.

    Runs of `run` places are added up first, so that a task orders a run, or a row for each run of a group.
    """
    running = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    keyed = counts.withColumn("_run", F.floor(F.col(order) / run))
    sums = keyed.groupBy(*group, "_run").agg(F.sum(n).alias("_sum"))
    sums = sums.select(*group, "_run", running("_sum", W.partitionBy(*group).orderBy("_run")).alias("_start"))
    return keyed.join(sums, [*group, "_run"]).withColumn(out, F.col("_start") + running(n, W.partitionBy(*group, "_run").orderBy(order))).drop("_run", "_start")


def ranks(rows: DataFrame, group: list[str], order: str, ties: list[str], out: str, most: int = 100_000) -> DataFrame:
    """rows with their 1-based rank `out` in the group, by `order` (a double in [0, 1)), then `ties`.

    Each group is cut into ranges of `order` of about equal counts, so that no task sorts more than one
    range of a group however large the group is; a range holds at most about `most` rows. The ranges'
    counts, added up in order, give each range the rank it starts from. Rows equal in `order` and `ties`
    share a range and take its ranks in any order.
    """
    total = rows.count()
    each = max(1, min(most, total // (16 * partitions(rows.sparkSession))))
    if group:
        sizes = park(rows.groupBy(*group).agg(F.count("*").alias("_size")))
        rows = attach(rows, sizes, group, "_size", total, order)
        rows = rows.withColumn("_ranges", F.ceil(F.col("_size") / each)).drop("_size")
    else:
        rows = rows.withColumn("_ranges", F.lit(max(1, -(-total // each))))
    rows = rows.withColumn("_range", F.floor(F.col(order) * F.col("_ranges"))).drop("_ranges")
    counts = rows.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = starts(counts, group, "_range", "_n", "_before").drop("_n")
    within = F.row_number().over(W.partitionBy(*group, "_range").orderBy(order, *ties))
    return rows.join(before, [*group, "_range"]).withColumn(out, F.col("_before") + within).drop("_range", "_before")


def sorted_parts(rows: DataFrame, order: list) -> DataFrame:
    """rows in parts `_part` that follow each other in the order, stored, so that the parts stay as they are."""
    return park(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id()))


def null_safe(column: Column) -> Column:
    """A string that tells null from every value: 'n' for null, 's' and the value otherwise."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))
