"""Interval algebra on (chrom, start, end), 0-based half-open: joins, filters, merging, tiling.

Overlap joins are equi-joins on (chrom, bin): both sides are repeated for the bins they reach into, and a pair
counts in one bin only, that of the later start. Nothing is a nested loop, and no pair is made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.operators.ordered import asof, ordinals, running
from locuslake.sources.store import park

BIN = 20_000
#: Positions in a segment within which intervals are merged first, before whole chromosomes are.
SEGMENT = 1 << 20


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))


def fitting_width(regions: DataFrame, least: int = 64) -> int:
    """A width of bins in which regions stand in one or two bins each and meet little beside what they hold: their mean
    length, rounded up to a power of two, BIN at most."""
    mean = regions.filter("end > start").agg(F.avg(F.col("end") - F.col("start"))).first()[0] or BIN
    return min(BIN, max(least, 1 << (int(mean) - 1).bit_length()))


def overlap(a: DataFrame, b: DataFrame, width: int = BIN, suffix: str = "_b", within: bool = False) -> DataFrame:
    """Pairs of overlapping intervals: a's columns, and b's with a suffix. Touching is not overlapping; empty
    intervals overlap nothing. within: only pairs where a lies inside b."""
    right = b.filter("end > start").select([F.col(c).alias(f"{c}{suffix}") for c in b.columns])
    s2, e2 = F.col(f"start{suffix}"), F.col(f"end{suffix}")
    left = a.filter("end > start").withColumn("_bin", _bins(F.col("start"), F.col("end"), width))
    right = right.withColumn("_bin2", _bins(s2, e2, width))
    meet = (F.col("chrom") == F.col(f"chrom{suffix}")) & (F.col("_bin") == F.col("_bin2")) & (F.col("start") < e2) & (s2 < F.col("end"))
    owner = F.col("_bin") == F.floor(F.greatest(F.col("start"), s2) / width)
    inside = (F.col("start") >= s2) & (F.col("end") <= e2) if within else F.lit(True)
    return left.join(right, meet & owner & inside).drop("_bin", "_bin2")


def _touching(a: DataFrame, b: DataFrame, how: str, within: bool, width: int, longest: int | None) -> DataFrame:
    """Semi- or anti-join: b is repeated for every bin in which an interval of a that meets it can start."""
    if longest is None:
        longest = a.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 1
        if longest > 8 * width:
            # long intervals apart, so that they do not widen the bins of the others
            size = F.col("end") - F.col("start")
            short, long = a.filter(F.coalesce(size <= 8 * width, F.lit(True))), a.filter(size > 8 * width)
            return _touching(short, b, how, within, width, 8 * width).unionByName(_touching(long, b, how, within, width, longest))
    width = max(width, longest // 8)
    right = b.filter("end > start").select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    right = right.withColumn("_bin", _bins(F.col("_start") - longest, F.col("_end"), width))
    meet = (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end")) & (F.col("end") > F.col("start"))
    if within:
        meet &= (F.col("start") >= F.col("_start")) & (F.col("end") <= F.col("_end"))
    return a.join(right, (F.col("chrom") == F.col("_chrom")) & (F.floor(F.col("start") / width) == F.col("_bin")) & meet, how)


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """Rows of a that overlap some row of b. longest: the length of a's longest interval, if known."""
    return _touching(a, b, "left_semi", False, width, longest)


def not_overlapping(a: DataFrame, b: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """Rows of a that overlap no row of b."""
    return _touching(a, b, "left_anti", False, width, longest)


def contained(a: DataFrame, b: DataFrame, width: int = BIN, longest: int | None = None) -> DataFrame:
    """Rows of a that lie inside some row of b; merge b first where the union counts."""
    return _touching(a, b, "left_semi", True, width, longest)


def contained_in_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return contained(a, merge(b))


def locate(regions: DataFrame, clusters: DataFrame, width: int = BIN, outside: str = "error") -> DataFrame:
    """Each region with its cluster and its relative start; one that lies inside none is an error, or with outside =
    "drop" left out. Clusters are disjoint; they are repeated for their bins, regions are not, since a region's start
    lies in its cluster."""
    if outside not in ("error", "drop"):
        raise ValueError(f"outside is {outside}, not error or drop")
    own = clusters.select([F.col(c).alias(f"{c}_cluster") for c in clusters.columns])
    s2, e2 = F.col("start_cluster"), F.col("end_cluster")
    own = own.filter(e2 > s2).withColumn("_bin2", F.explode(F.sequence(F.floor(s2 / width), F.floor(e2 / width))))
    inside = (F.col("chrom") == F.col("chrom_cluster")) & (F.floor(F.col("start") / width) == F.col("_bin2")) & (F.col("start") >= s2) & (F.col("end") <= e2)
    if outside == "error":
        missing = regions.join(own, inside, "left_anti").count()
        if missing:
            raise ValueError(f"{missing} regions lie outside every cluster")
    found = regions.join(own, inside).drop("_bin2")
    return found.withColumn("relative_start", F.col("start") - s2).withColumn("size", F.col("end") - F.col("start"))


def extend(regions: DataFrame, slop: int) -> DataFrame:
    """Intervals longer by slop at both ends, not below 0."""
    return regions.withColumn("start", F.greatest(F.col("start") - slop, F.lit(0))).withColumn("end", F.col("end") + slop)


def _flag(before: W) -> Column:
    return F.coalesce((F.col("start") > F.max("end").over(before)).cast("long"), F.lit(1))


def cluster(regions: DataFrame) -> DataFrame:
    """regions with `cluster`, numbered from 1 in each chromosome: a new one starts where a start exceeds all ends before.

    Segments of a chromosome are clustered first; only their islands are ordered along whole chromosomes.
    """
    rows = regions.withColumn("_segment", F.floor(F.col("start") / SEGMENT))
    own = W.partitionBy("chrom", "_segment").orderBy("start", "end")
    rows = rows.withColumn("_new", _flag(own.rowsBetween(W.unboundedPreceding, -1))).withColumn("_local", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    islands = rows.groupBy("chrom", "_segment", "_local").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    along = W.partitionBy("chrom").orderBy("start", "end")
    islands = islands.withColumn("_new", _flag(along.rowsBetween(W.unboundedPreceding, -1))).withColumn("cluster", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return rows.drop("_new").join(islands.select("chrom", "_segment", "_local", "cluster"), ["chrom", "_segment", "_local"]).drop("_segment", "_local")


def merge(regions: DataFrame) -> DataFrame:
    """(chrom, start, end) of the union; overlapping and touching intervals become one."""
    return cluster(regions.select("chrom", "start", "end")).groupBy("chrom", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end")


def subtract(a: DataFrame, b: DataFrame, key: list[str], width: int = BIN) -> DataFrame:
    """a's columns for each piece of a that b does not cover; a row may vanish or be split. key identifies a row of a."""
    cuts = overlap(a, merge(b), width)
    w = W.partitionBy(*key).orderBy("start_b")
    gap_start = F.coalesce(F.lag("end_b").over(w), F.col("start"))
    last = F.lead("end_b").over(w).isNull()
    pieces = cuts.withColumn("_pieces", F.array(F.struct(gap_start.alias("s"), F.col("start_b").alias("e")), F.struct(F.col("end_b").alias("s"), F.when(last, F.col("end")).otherwise(F.col("end_b")).alias("e"))))
    pieces = pieces.withColumn("_piece", F.explode("_pieces")).filter("_piece.e > _piece.s")
    split = pieces.withColumn("start", F.col("_piece.s")).withColumn("end", F.col("_piece.e")).select(a.columns)
    return not_overlapping(a, b, width).unionByName(split)


def complement(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """What regions leave of whole chromosomes. sizes: chrom, size."""
    whole = sizes.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"))
    return subtract(whole, regions, ["chrom"])


def windows(sizes: DataFrame, size: int, step: int, full_only: bool = True) -> DataFrame:
    """Windows of a size at every step along each chromosome; short ones at the end are dropped or kept short."""
    w = sizes.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    w = w.withColumn("end", F.least(F.col("start") + size, F.col("size")))
    return (w.filter(F.col("end") - F.col("start") == size) if full_only else w).select("chrom", "start", "end")


def tiles(regions: DataFrame, step: int, window: int) -> DataFrame:
    """Tiles of the merged regions by step, from each one's start, widened to windows around the tile's start."""
    t = merge(regions).withColumn("tile", F.explode(F.sequence("start", F.col("end") - 1, F.lit(step).cast("long"))))
    return t.select("chrom", F.greatest(F.col("tile") - window // 2, F.lit(0)).alias("start"), (F.col("tile") + window // 2).alias("end"), "tile")


def chrom_offsets(sizes: DataFrame) -> DataFrame:
    """chrom, size, global_start, global_end on the genome laid end to end, chromosomes in order of their names."""
    before = W.orderBy("chrom").rowsBetween(W.unboundedPreceding, -1)
    out = sizes.select("chrom", "size").withColumn("global_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return out.withColumn("global_end", F.col("global_start") + F.col("size"))


def to_global(regions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds gstart and gend; the end is cut at the chromosome's."""
    j = regions.join(offsets.select("chrom", "global_start", "global_end"), "chrom")
    return j.withColumn("gstart", F.col("start") + F.col("global_start")).withColumn("gend", F.least(F.col("end") + F.col("global_start"), F.col("global_end"))).drop("global_start", "global_end")


def from_global(regions: DataFrame, offsets: DataFrame) -> DataFrame:
    """chrom, start, end from gstart and gend; the chromosome is the last one that begins at or before the start, null past
    the genome's end. An as-of join, so that there may be any number of chromosomes; empty ones own nothing."""
    marks = offsets.filter("global_end > global_start").select(F.col("global_start").alias("_g"), "global_start", "global_end", "chrom")
    negative = F.raise_error(F.lit("negative global position")).cast("long")
    points = regions.drop("chrom", "start", "end").withColumn("_g", F.when(F.col("gstart") < 0, negative).otherwise(F.col("gstart")).cast("long"))
    hit = asof(points, marks.withColumns({"_g": F.col("_g").cast("long"), "_s": F.col("global_start"), "_e": F.col("global_end"), "_c": F.col("chrom")}), [], "_g", ["_s", "_e", "_c"])
    inside = F.col("gstart") < F.col("_e")
    out = hit.withColumns({"chrom": F.when(inside, F.col("_c")), "start": F.when(inside, F.col("gstart") - F.col("_s")), "end": F.when(inside, F.col("gend") - F.col("_s"))})
    return out.drop("_g", "_s", "_e", "_c")


def inner_windows(regions: DataFrame) -> DataFrame:
    """All but the first and the last window of each chromosome, by start and end; a lone one is both, and windows with
    the same ends as one of them go with it. Chromosomes aren't sorted: their first and last windows are aggregates."""
    place = F.struct("start", "end")
    ends = regions.groupBy("chrom").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    return regions.join(ends, "chrom").filter((place > F.col("_first")) & (place < F.col("_last"))).select(regions.columns)


def without_leakage(regions: DataFrame, split: str = "split", width: int = BIN) -> DataFrame:
    """Regions that overlap none of another split; all splits are taken as they were at first."""
    pairs = overlap(regions.select("chrom", "start", "end", split).distinct(), regions.select("chrom", "start", "end", split).distinct(), width).filter(F.col(split) != F.col(f"{split}_b"))
    return regions.join(pairs.select("chrom", "start", "end", split).distinct(), ["chrom", "start", "end", split], "left_anti").select(regions.columns)


def densify(sparse: DataFrame, regions: DataFrame, keys: list[str], n_bins: int, value: str = "value") -> DataFrame:
    """A row for every key of regions and bin 0 .. n_bins-1, 0 where sparse (keys, bin, value) has none."""
    grid = regions.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    return grid.join(sparse.select(*keys, "bin", value), [*keys, "bin"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def nearby(regions: DataFrame, most: int, key: str, seed: int = 0) -> DataFrame:
    """(key, partner): for each region one of its chromosome whose start is less than `most` away, itself included; each
    is as likely as any other. Regions are of one length, so that ends are as far apart as starts; key is unique.

    The regions in reach follow each other in the order of starts: two as-of lookups give the first and the last rank, a
    hash picks one between them, and an equi-join fetches it. As many rows are joined as there are regions.
    """
    placed = running(regions.select("chrom", F.col("start").cast("long").alias("start"), F.col(key).alias("_key")).withColumn("_one", F.lit(1)), ["chrom"], ["start", "_key"], "_one", "_rank", "_n")
    placed = park(placed.select("chrom", "start", "_key", "_rank"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("start") - most).alias("at")), F.struct(F.lit(1).alias("side"), (F.col("start") + most - 1).alias("at")))).alias("_e")
    points = placed.select("chrom", "_key", ends).select("chrom", "_key", "_e.side", F.col("_e.at").alias("start"))
    ranked = asof(points, placed.select("chrom", "start", F.col("_rank").alias("_last")), ["chrom"], "start", ["_last"])
    of_side = lambda side: F.max(F.when(F.col("side") == side, F.col("_last")))
    reach = ranked.groupBy("chrom", "_key").agg((F.coalesce(of_side(0), F.lit(-1)) + 1).alias("_lo"), of_side(1).alias("_hi"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("_key").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("long")
    wanted = reach.select("chrom", F.col("_key").alias(key), (F.col("_lo") + F.pmod(drawn, F.col("_hi") - F.col("_lo") + 1)).alias("_rank"))
    return wanted.join(placed.select("chrom", "_rank", F.col("_key").alias("partner")), ["chrom", "_rank"]).select(key, "partner")


def nearby_of_any_length(regions: DataFrame, most: int, key: str, seed: int = 0) -> DataFrame:
    """(key, partner): for each region one of its chromosome with a gap of less than `most` between their ends, itself
    included, of whatever lengths; of all in reach the one with the least hash of both keys.

    With lengths that differ, those in reach don't follow each other in any one order, so that ranks don't find them all:
    each pair in reach is made once, in an equi-join on (chrom, bin). Empty regions have a place and can be drawn. The
    join is a shuffled one: sizes of narrow tables are judged too small, and a broadcast would hold all regions.
    """
    width = max(BIN, 2 * most)
    binned = lambda df, s, e: df.withColumn("_bin", _bins(F.col(s), F.greatest(F.col(e), F.col(s) + 1), width))
    own = regions.select("chrom", F.col(key).alias("_key"), F.greatest(F.col("start") - most, F.lit(0)).alias("_from"), (F.col("end") + most).alias("_to"))
    other = regions.select("chrom", F.col(key).alias("_other"), "start", "end")
    meet = (F.col("_from") < F.col("end")) & (F.col("start") < F.col("_to")) & (F.col("_bin") == F.floor(F.greatest("_from", "start") / width))
    pairs = binned(own, "_from", "_to").join(binned(other, "start", "end").hint("merge"), ["chrom", "_bin"]).filter(meet)
    drawn = F.md5(F.concat_ws("|", F.col("_key").cast("string"), F.col("_other").cast("string"), F.lit(str(seed))))
    return pairs.groupBy(F.col("_key").alias(key)).agg(F.min_by("_other", F.struct(drawn, "_other")).alias("partner"))


def minimum_cover(regions: DataFrame) -> DataFrame:
    """Few regions that cover each cluster: from the first on, jump to the last one that overlaps the current one, or
    to the next one if none does. Of regions with equal ends one stands for all: the least by its other columns.

    Where a jump ends is an as-of lookup of the current end among the starts. Which regions the jumps reach is found by
    pointer doubling: tables of 1, 2, 4, ... jumps are joined with themselves, and what is reached from the clusters' first
    regions grows by the tables from the longest jumps down. Rounds grow with the logarithm of the longest chain.
    """
    place = ["chrom", "start", "end"]
    rest = [c for c in regions.columns if c not in place]
    # a jump ends at the longest region of a start, a step to the next one at its shortest
    edges = regions.groupBy("chrom", "start").agg(F.array_distinct(F.array(F.min("end"), F.max("end"))).alias("_ends"))
    clustered = cluster(edges.select("chrom", F.col("start").cast("long").alias("start"), F.explode(F.col("_ends").cast("array<long>")).alias("end")))
    placed = park(ordinals(clustered, place, "_at"))
    last = asof(placed.select("chrom", F.col("end").alias("start"), "cluster", "_at"), placed.select("chrom", "start", F.col("_at").alias("_to")), ["chrom"], "start", ["_to"], strict=True)
    ends = placed.groupBy("chrom", "cluster").agg(F.min("_at").alias("_first"), F.max("_at").alias("_end"))
    jump = last.join(ends, ["chrom", "cluster"]).select("_at", F.greatest("_to", F.col("_at") + 1).alias("_to"), "_end").filter("_to <= _end")
    jumps = [park(jump.select("_at", "_to"))]
    while not jumps[-1].isEmpty():
        then = jumps[-1].select(F.col("_at").alias("_to"), F.col("_to").alias("_then"))
        jumps.append(park(jumps[-1].join(then, "_to").select("_at", F.col("_then").alias("_to"))))
    reached = park(ends.select(F.col("_first").alias("_at")))
    for table in reversed(jumps[:-1]):
        reached = park(reached.unionByName(reached.join(table, "_at").select(F.col("_to").alias("_at"))).distinct())
    chosen = placed.join(reached, "_at").select(*place, F.col("cluster").alias("_cluster"))
    one = regions.join(chosen, place, "left_semi").groupBy(*place).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("_rest"))
    return one.join(chosen, place).select(*place, *[F.col(f"_rest.{c}").alias(c) for c in rest], F.col("_cluster").alias("cluster"))


def covered_positions(points: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """(chrom, pos, value): the distinct positions inside some region, with value 1."""
    at = points.select("chrom", "pos").distinct().withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    return overlapping(at, regions, width, longest=1).select("chrom", "pos", F.lit(1).alias("value"))
