"""Positions as bits: Spark's bitmaps, each of 32,768 positions of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bit_masks(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", resolution: int = 1) -> DataFrame:
    """(keys, bucket, mask): the bins of `resolution` that half-open spans of a key touch, as bits. Overlapping spans share
    bits, empty ones have none. Bitmaps are merged before the shuffle, which carries 4 KB for each key, bucket and task at most."""
    s, e = F.col(start), F.col(end)
    bins = F.explode(F.sequence(F.floor(s / resolution), F.floor((e - 1) / resolution)))
    # bits are numbered from 1
    at = spans.filter(e > s).select(*keys, bins.alias("_bin")).withColumn("_at", F.col("_bin") + 1)
    return at.groupBy(*keys, F.bitmap_bucket_number("_at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("mask"))


def united(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bucket, mask): the bits that any of the masks has."""
    return masks.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("mask").alias("mask"))


def bits(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): how many bits are set over all buckets."""
    return masks.groupBy(*keys).agg(F.sum(F.bitmap_count("mask")).alias("n"))
