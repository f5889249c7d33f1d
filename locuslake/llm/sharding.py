"""Proportional stratified interleaving of a corpus into shards.

Within each source the rows are put in a seeded random order; a row's fractional rank is (rank - 1 + phase) / n, with a
phase in [0, 1) for each source, a seeded hash of its name. Sorting all rows by fractional rank spreads every source
evenly over the whole order, and sources with the same few rows over all of it, so that cutting the order into equal runs
gives shards that each hold the mixture. The law that holds is `rows`: shard sizes differ by one row at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.llm.shared import attach, named, null_safe, park, ranks, unit_hash

SHARDS = 40
SEED = 3


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 16; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def cut(position: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a 0-based position: the first total mod shards shards take one row more."""
    small, longer = divmod(total, shards)
    edge = longer * (small + 1)
    in_longer = position < edge
    past = position - edge
    shard = F.when(in_longer, F.floor(position / (small + 1))).otherwise(longer + F.floor(past / max(small, 1)))
    slot = F.when(in_longer, F.pmod(position, F.lit(small + 1))).otherwise(F.pmod(past, F.lit(max(small, 1))))
    return shard.cast("int"), slot.cast("long")


def interleave(rows: DataFrame, source: str, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard).

    `keys` seed the shuffle and settle ties; rows equal in all of them are interchangeable, and each still
    takes a slot of its own. A null source is a source of its own. Columns of the input named shard or
    slot are replaced. An empty table gives none.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    inner = rows.select(
        F.struct(*map(named, kept)).alias("_row"), null_safe(F.col(source)).alias("_source"),
        unit_hash(seed, *[F.col(k) for k in keys]).alias("_at"), F.xxhash64(*[F.col(k) for k in keys]).alias("_tie"),
    )
    counts = park(inner.groupBy("_source").agg(F.count("*").alias("_n")))
    total = inner.count()
    placed = attach(ranks(inner, ["_source"], "_at", ["_tie"], "_rank"), counts, ["_source"], "_n", total, "_at")
    placed = placed.withColumn("_fraction", (F.col("_rank") - 1 + unit_hash(seed + 1, F.col("_source"))) / F.col("_n")).drop("_n", "_rank")
    placed = park(placed)
    shard, slot = cut(F.col("_position") - 1, total, shards)
    return ranks(placed, [], "_fraction", ["_source", "_at", "_tie"], "_position").select("_row.*", shard.alias("shard"), slot.alias("slot"))


def mixture(sharded: DataFrame, source: str) -> DataFrame:
    """(shard, source, n, share): how far each shard holds the mixture."""
    share = F.col("n") / F.sum("n").over(W.partitionBy("shard"))
    return sharded.groupBy("shard", source).agg(F.count("*").alias("n")).withColumn("share", share)
