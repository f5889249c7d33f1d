"""Column functions on regions: 0-based half-open (chrom, start, end) and their string form chrom:start-end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REGION = r"^([^:]+):(\d+)-(\d+)$"


def parse_region(region: Column, strict: bool = True) -> Column:
    """struct(chrom, start, end) of a region string; a malformed one raises an error, or is null if not strict."""
    parts = F.struct(
        F.regexp_extract(region, _REGION, 1).alias("chrom"), F.regexp_extract(region, _REGION, 2).try_cast("long").alias("start"),
        F.regexp_extract(region, _REGION, 3).try_cast("long").alias("end"),
    )
    bad = F.raise_error(F.concat(F.lit("malformed region: "), region)).cast("struct<chrom:string,start:bigint,end:bigint>") if strict else F.lit(None)
    return F.when(region.rlike(_REGION), parts).when(region.isNotNull(), bad)


def format_region(chrom: Column, start: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def standardize(length: int, start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds of the window of an even length around the middle of a region, which is rounded down."""
    if length % 2:
        raise ValueError("the standard length must be even")
    middle = F.floor((start + end) / 2)
    return (middle - length // 2).cast("long"), (middle + length // 2).cast("long")


def shift_inside(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """Moves a window that sticks out of [0, size) back in: at the left edge first, then at the right one."""
    length = end - start
    s = F.greatest(start, F.lit(0))
    e = s + length
    s2 = F.when(e > size, F.greatest(size - length, F.lit(0))).otherwise(s)
    return s2.cast("long"), F.least(s2 + length, size).cast("long")


def shrink(start: Column, end: Column, length: int) -> tuple[Column, Column]:
    """The middle part of a window that a centre-cropped output of the given length covers."""
    margin = F.floor((end - start - length) / 2)
    return start + margin, end - margin


def centre_crop(values: Column, n: int) -> Column:
    """The middle n elements of an array."""
    return F.slice(values, F.floor((F.size(values) - n) / 2).cast("int") + 1, n)


def bin_floor(x: Column, start: Column, resolution: int, n_bins: int) -> Column:
    """Bin of a position, rounded down and kept in [0, n_bins]."""
    return F.least(F.greatest(F.floor((x - start) / resolution), F.lit(0)), F.lit(n_bins)).cast("long")


def bin_round(x: Column, start: Column, resolution: int) -> Column:
    """Bin of a position, rounded half to even."""
    return F.bround((x - start) / F.lit(float(resolution)), 0).cast("long")


def meta_bin(start: Column, end: Column, width: int) -> Column:
    """Bin of a region on a coarse grid: its start's if less of it lies past the next border than before it, else its end's."""
    first, last = F.floor(start / width), F.floor(end / width)
    return F.when((first == last) | (width - F.pmod(start, F.lit(width)) >= F.pmod(end, F.lit(width))), first).otherwise(last).cast("long")


def jitter(key: Column, most: int, seed: int) -> Column:
    """A shift in [-most, most] that depends on the key and the seed alone."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2 * most + 1)) - most).cast("long")


def tss(start: Column, end: Column, strand: Column) -> Column:
    """Transcription start by strand, as the 1-based position on '+' and the end on '-'."""
    return F.when(strand == "-", end).otherwise(start + 1)


def gene_mask(start: Column, end: Column, gene_start: Column, gene_end: Column, strand: Column) -> tuple[Column, Column]:
    """Gene bounds (1-based start) relative to a window, cut to it, and flipped on the minus strand."""
    size = end - start
    a = F.least(F.greatest(gene_start - 1 - start, F.lit(0)), size)
    b = F.least(F.greatest(gene_end - start, F.lit(0)), size)
    minus = strand == "-"
    return F.when(minus, size - b).otherwise(a), F.when(minus, size - a).otherwise(b)


def relative_position(pos: Column, start: Column, end: Column, strand: Column) -> Column:
    """0-based position of a 1-based one in a window, counted from its end on the minus strand."""
    return F.when(strand == "-", end - (pos - 1) - 1).otherwise(pos - 1 - start)


def variant_window(variant: Column, length: int, radius: int) -> Column:
    """struct(chrom, start, end, peak_start, peak_end, pos, ref, alt) of an id chrom_pos_ref_alt with a 1-based position."""
    part = F.split(variant, "_")
    pos = F.get(part, F.lit(1)).cast("long") - 1
    return F.struct(
        F.get(part, F.lit(0)).alias("chrom"), (pos - length // 2).alias("start"), (pos + length // 2).alias("end"),
        (pos - radius).alias("peak_start"), (pos + radius).alias("peak_end"), pos.alias("pos"), F.get(part, F.lit(2)).alias("ref"), F.get(part, F.lit(3)).alias("alt"),
    )


def check_regions(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row with counts of violations: negative start, empty, unknown chromosome, past its end. sizes: chrom, size (small)."""
    j = regions.join(sizes.select("chrom", "size"), "chrom", "left")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(
        F.count("*").alias("n"), count(F.col("start") < 0).alias("negative_start"), count(F.col("end") <= F.col("start")).alias("empty"),
        count(F.col("size").isNull()).alias("unknown_chrom"), count(F.coalesce(F.col("end") > F.col("size"), F.lit(False))).alias("past_end"),
    )


def require_valid(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """regions, or an error that counts what is wrong with them."""
    found = {k: v for k, v in check_regions(regions, sizes).first().asDict().items() if k != "n" and v}
    if found:
        raise ValueError(f"invalid regions: {found}")
    return regions
