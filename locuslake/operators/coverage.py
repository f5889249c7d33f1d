"""The long-form coverage store: one row (dataset, prefix, chrom, bin, row_id, value) for each non-zero bin.

fragments: chrom, start, end, cell[, sample]; insertions: cell, chrom, pos, n; members: row -> group (a row may be in several).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.functions.regions import format_region, meta_bin
from locuslake.operators.checks import small
from locuslake.operators.intervals import BIN, densify, fitting_width, overlap
from locuslake.operators.ordered import ordinals


def insertions(fragments: DataFrame, keys: list[str], plus: int = 0, minus: int = 0, paired: bool = True) -> DataFrame:
    """Cut sites with their counts: both ends of a fragment, or its 5' end by strand; duplicates are summed."""
    first, last = F.col("start") + plus, F.col("end") - 1 + minus
    at = F.explode(F.array(first, last)) if paired else F.when(F.col("strand") == "-", last).otherwise(first)
    return fragments.select(*keys, "chrom", at.alias("pos")).groupBy(*keys, "chrom", "pos").agg(F.count("*").alias("n"))


def enough_fragments(fragments: DataFrame, least: int = 200, whitelist: DataFrame | None = None) -> DataFrame:
    """Fragments of cells that have at least `least` of them and are on the whitelist, if there is one."""
    rows = fragments if whitelist is None else fragments.join(whitelist.select("cell").distinct(), "cell", "left_semi")
    good = rows.groupBy("cell").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(good, "cell", "left_semi")


def rebin(positions: DataFrame, keys: list[str], factor: int, pos: str = "pos", value: str = "n") -> DataFrame:
    """Sums of `factor` consecutive positions."""
    return positions.groupBy(*keys, F.floor(F.col(pos) / factor).alias("bin")).agg(F.sum(value).alias("value"))


def merge_rows(coverage: DataFrame, members: DataFrame, keys: list[str], row: str = "row_id", group: str = "pid", clip: int | None = None) -> DataFrame:
    """Sums the rows of each group, per keys; partial sums are made before the shuffle, in one pass over all inputs."""
    total = F.sum("value")
    return coverage.join(members.select(row, group), row).groupBy(group, *keys).agg((F.least(total, F.lit(clip)) if clip is not None else total).alias("value"))


def audit_members(members: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """(pid, expected, found): how many of each group's members the store knows."""
    j = members.join(names.select(key, F.lit(1).alias("_known")), key, "left")
    return j.groupBy("pid").agg(F.count("*").alias("expected"), F.count("_known").alias("found"))


def row_ids(members: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """members with row_id; a name that the store lacks is an error."""
    missing = members.join(names, key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"rows not in the store: {[r[key] for r in missing]}")
    return members.join(names.select(key, "row_id"), key)


def depth(coverage_sums: DataFrame, target: float, group: str = "pid") -> DataFrame:
    """(group, n_frags, cov_scale): total and log2(total / target) of each group."""
    t = coverage_sums.groupBy(group).agg(F.sum("value").alias("n_frags"))
    return t.withColumn("cov_scale", F.log2(F.col("n_frags") / F.lit(float(target))))


def normalize(merged: DataFrame, depths: DataFrame, group: str = "pid") -> DataFrame:
    """Values divided by 2^cov_scale of their group."""
    return merged.join(depths.select(group, "cov_scale"), group).withColumn("value", F.col("value") / F.pow(F.lit(2.0), F.col("cov_scale"))).drop("cov_scale")


def region_totals(regions: DataFrame, points: DataFrame, keys: list[str], pos: str = "pos", value: str = "n", width: int | None = None) -> DataFrame:
    """Sum of point values inside each region, per keys (columns of either side). width: by default from the regions' lengths."""
    width = width or fitting_width(regions)
    p = points.withColumn("start", F.col(pos)).withColumn("end", F.col(pos) + 1)
    return overlap(regions, p, width, "_p").groupBy(*keys).agg(F.sum(f"{value}_p").alias("value"))


def region_query(regions: DataFrame, coverage: DataFrame, members: DataFrame, resolution: int, region_bins: int, dense: bool = False, width: int | None = None) -> DataFrame:
    """(name, pid, bin, value): the coverage of each region for each group, bins relative to the region.

    coverage: chrom, bin, row_id, value, at the resolution; only chromosomes of the regions are read.
    """
    width = width or fitting_width(regions, resolution)
    part = coverage.join(small(regions.select("chrom").distinct()), "chrom", "left_semi")  # prunes partitions
    spans = part.withColumn("start", F.col("bin") * resolution).withColumn("end", (F.col("bin") + 1) * resolution)
    hits = overlap(spans, regions, width, "_r").select(F.col("name_r").alias("name"), "row_id", (F.col("bin") - F.floor(F.col("start_r") / resolution)).alias("bin"), "value")
    out = merge_rows(hits, members, ["name", "bin"])
    if not dense:
        return out
    keys = regions.select("name").crossJoin(small(members.select("pid").distinct()))  # groups asked for, for each region asked for
    return densify(out, keys, ["name", "pid"], region_bins)


def peak_signal(signal: DataFrame, peaks: DataFrame, regions: DataFrame, resolution: int) -> DataFrame:
    """(peak, pid, value): sum of the bins of each peak that lies wholly inside a region, bins rounded down.

    signal: region, pid, bin, value; a region on the minus strand has its bins turned round.
    """
    inside = overlap(peaks, regions, BIN, "_r", within=True)
    n = F.floor((F.col("end_r") - F.col("start_r")) / resolution)
    b0, b1 = F.floor((F.col("start") - F.col("start_r")) / resolution), F.floor((F.col("end") - F.col("start_r")) / resolution)
    minus = F.coalesce(F.col("strand_r") == "-", F.lit(False)) if "strand" in regions.columns else F.lit(False)
    spans = inside.select(F.col("name").alias("peak"), F.col("name_r").alias("region"), F.when(minus, n - b1).otherwise(b0).alias("b0"), F.when(minus, n - b0).otherwise(b1).alias("b1"))
    j = signal.join(spans, "region").filter((F.col("bin") >= F.col("b0")) & (F.col("bin") < F.col("b1")))
    return j.groupBy("peak", "pid").agg(F.sum("value").alias("value"))


def window_sums(signal: DataFrame, targets: DataFrame, resolution: int) -> DataFrame:
    """(target, pid, value): sums of non-negative bins from b0 to b1, both rounded half to even.

    signal: region, pid, bin, value; targets: target, region, start (of the region), peak_start, peak_end.
    """
    b = lambda x: F.bround((F.col(x) - F.col("start")) / F.lit(float(resolution)), 0).cast("long")
    spans = targets.select("target", "region", b("peak_start").alias("b0"), b("peak_end").alias("b1"))
    j = signal.join(spans, "region").filter((F.col("bin") >= F.col("b0")) & (F.col("bin") < F.col("b1")))
    return j.groupBy("target", "pid").agg(F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("value"))


def mask_blacklist(signal: DataFrame, blacklist: DataFrame, resolution: int, slop_bins: int = 3, fill: float | None = 0.0) -> DataFrame:
    """Signal bins (chrom, bin, value, ...) near a blacklisted interval set to fill (null: missing)."""
    first = F.floor(F.col("start") / resolution) - slop_bins
    last = F.floor((F.col("end") - 1) / resolution) + slop_bins
    bins = blacklist.select("chrom", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("bin"), F.lit(True).alias("_hit")).distinct()
    return signal.join(bins, ["chrom", "bin"], "left").withColumn("value", F.when(F.col("_hit"), F.lit(fill).cast("double")).otherwise(F.col("value"))).drop("_hit")


def track_bins(track: DataFrame, regions: DataFrame, resolution: int, width: int = BIN) -> DataFrame:
    """(name, bin, value): a bedGraph-like track (chrom, start, end, value) summed per bin of each region; NaN is 0."""
    clean = track.withColumn("value", F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)))
    j = overlap(clean, regions, width, "_r")
    s, e = F.greatest(F.col("start"), F.col("start_r")) - F.col("start_r"), F.least(F.col("end"), F.col("end_r")) - F.col("start_r")
    j = j.select(F.col("name_r").alias("name"), s.alias("s"), e.alias("e"), "value").withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / resolution), F.floor((F.col("e") - 1) / resolution))))
    share = F.least(F.col("e"), (F.col("bin") + 1) * resolution) - F.greatest(F.col("s"), F.col("bin") * resolution)
    return j.groupBy("name", "bin").agg(F.sum(F.col("value") * share).alias("value"))


def track_means(track: DataFrame, regions: DataFrame, width: int = BIN, keys: tuple[str, ...] = ()) -> DataFrame:
    """(name, keys, value): mean of a track over the covered bases of each region; missing values don't count."""
    j = overlap(track.filter("value is not null and not isnan(cast(value as double))"), regions, width, "_r")
    n = F.least(F.col("end"), F.col("end_r")) - F.greatest(F.col("start"), F.col("start_r"))
    return j.groupBy(F.col("name_r").alias("name"), *keys).agg((F.sum(F.col("value") * n) / F.sum(n)).alias("value"))


def assemble_track(outputs: DataFrame, resolution: int, trim: int = 0) -> DataFrame:
    """(pid, chrom, bin, value): window outputs laid on the chromosome; the largest batch wins where windows overlap.

    outputs: pid, batch, chrom, start, values (array); trim bins are left out at both ends.
    """
    kept = F.slice(F.col("values"), trim + 1, F.greatest(F.size("values") - 2 * trim, F.lit(0)))
    bins = outputs.select("pid", "batch", "chrom", F.floor(F.col("start") / resolution).alias("b0"), F.posexplode(kept).alias("k", "v"))
    return bins.groupBy("pid", "chrom", (F.col("b0") + trim + F.col("k")).alias("bin")).agg(F.max_by("v", F.struct("batch", "b0")).alias("value"))


def reference_bulk(coverage: DataFrame, members: DataFrame, n: int, target: float, seed: int = 0) -> DataFrame:
    """Bulk coverage of up to n members chosen by hash, scaled to a total of target."""
    drawn = F.md5(F.concat_ws("|", F.col("row_id").cast("string"), F.lit(str(seed))))
    chosen = members.select("row_id").distinct().orderBy(drawn, "row_id").limit(n)
    bulk = coverage.join(chosen, "row_id", "left_semi").groupBy("chrom", "bin").agg(F.sum("value").alias("value"))
    total = bulk.agg(F.sum("value").alias("_total"))
    return bulk.crossJoin(F.broadcast(total)).withColumn("value", F.col("value") * target / F.col("_total")).drop("_total")  # the total is one row


def write_store(coverage: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Writes a coverage store: a directory per dataset and chromosome, rows in order of their bins."""
    (coverage.repartitionByRange("dataset", "chrom", "bin").sortWithinPartitions("dataset", "chrom", "bin")
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("dataset", "chrom").parquet(path))


def read_store(spark: SparkSession, path: str, chroms: list[str] | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """A coverage store, only the given chromosomes and bins; without any of the chromosomes it is an error."""
    store = spark.read.parquet(path)
    if chroms is not None:
        store = store.filter(F.col("chrom").isin(list(chroms)))
        if store.isEmpty():
            raise ValueError(f"no chromosome of {list(chroms)} is in the store")
    return store if bins is None else store.filter((F.col("bin") >= bins[0]) & (F.col("bin") < bins[1]))


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, file, row): where a stored table holds each key, the file and the row in it from 0. Only the key is read."""
    return spark.read.parquet(path).select(key, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def rows_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The rows of a stored table at places (file, row) of its manifest. Places are few beside the table: where they are, they
    are broadcast to its scan."""
    store = spark.read.parquet(path)
    placed = store.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(small(places.select(F.col("file").alias("_file"), F.col("row").alias("_row")).distinct()), ["_file", "_row"], "left_semi").select(store.columns)


def read_in_order(spark: SparkSession, path: str, out: str = "row_order") -> DataFrame:
    """A stored table with the place of each row in it, from 0: files in order of their names, rows as they stand in them.

    Nothing is sorted or shuffled: a row's place is its file's first place and its index in the file, and the table of
    files' first places has a row for each file.
    """
    store = spark.read.parquet(path)
    placed = store.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(small(starts), "_file").withColumn(out, F.col("_start") + F.col("_row")).select(*store.columns, out)


def in_row_order(rows: DataFrame, order: str = "row_order") -> DataFrame:
    """rows sorted back into the order they were read in, whatever operators came between, without the place."""
    return rows.orderBy(order).drop(order)


def write_lookup(rows: DataFrame, path: str, table: str, key: str, buckets: int) -> None:
    """Writes rows as an external table for lookups by key: dealt to buckets by the key and sorted by it in each, with bloom
    filters, so that one key reads few row groups and a join on the key moves the other side only."""
    n = rows.agg(F.approx_count_distinct(key)).first()[0]
    (rows.repartition(buckets, key).write.mode("overwrite").option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, n // buckets))).bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def look_up(spark: SparkSession, table: str, wanted: DataFrame | list, key: str) -> DataFrame:
    """The rows of a lookup table whose key is wanted, each once however often it is: a few keys as a filter that reaches row
    groups' bloom filters and buckets, a table of keys by a join that deals only the keys to the table's buckets."""
    store = spark.table(table)
    if isinstance(wanted, list):
        return store.filter(F.col(key).isin(wanted))
    return store.join(wanted.select(key).distinct(), key, "left_semi")


def by_expression(coverage: DataFrame, keys: list[str], cov_func: Column) -> DataFrame:
    """Aggregates coverage by keys with any aggregate expression."""
    return coverage.groupBy(*keys).agg(cov_func.alias("value"))


def write_folds(store: DataFrame, path: str) -> None:
    """Writes rows with a fold as a directory per fold."""
    store.repartitionByRange("fold", "chrom", "bin").sortWithinPartitions("fold", "chrom", "bin").write.mode("overwrite").partitionBy("fold").parquet(path)


def read_folds(spark: SparkSession, path: str, folds: list, chroms: list[str]) -> DataFrame:
    """The rows of some folds of a store that has a directory per fold; of a store that has none, those of some
    chromosomes. Other directories are not read."""
    store = spark.read.parquet(path)
    if "fold" in store.columns:
        return store.filter(F.col("fold").isin(list(folds))).drop("fold")
    return store.filter(F.col("chrom").isin(list(chroms)))


def numbered_regions(store: DataFrame, order: list[str]) -> DataFrame:
    """store with `ordinal`, from 0, in an order; for region arrays, a row for each region."""
    return ordinals(store, order)


def select_regions(store: DataFrame, wanted: str | int | slice | list, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Rows of a region array by a name, a list of names, a place or a slice of places; unknown names are an error.

    Places may count from the end, as in lists; steps in slices must be positive.
    """
    if isinstance(wanted, (int, slice)):
        n = store.agg(F.max(ordinal)).first()[0]
        count = 0 if n is None else n + 1
        if isinstance(wanted, int):
            if not -count <= wanted < count:
                raise IndexError(f"no region {wanted} among {count}")
            return store.filter(F.col(ordinal) == wanted % max(count, 1))
        first, end, step = wanted.indices(count)
        if step < 1:
            raise ValueError("steps must be positive")
        return store.filter((F.col(ordinal) >= first) & (F.col(ordinal) < end) & (F.pmod(F.col(ordinal) - first, F.lit(step)) == 0))
    names = [wanted] if isinstance(wanted, str) else list(wanted)
    found = store.filter(F.col(name).isin(names))
    if found.select(name).distinct().count() != len(set(names)):
        raise KeyError("a region is not in the store")
    return found


def cell_matrix(points: DataFrame, whitelist: DataFrame | None = None, chroms: list[str] | None = None) -> DataFrame:
    """A cell x base matrix as rows (cell, chrom, pos, n): whitelisted cells only, and of the chromosomes asked for those
    with data; repeated entries are summed."""
    rows = points if chroms is None else points.filter(F.col("chrom").isin(list(chroms)))
    rows = rows if whitelist is None else rows.join(whitelist.select("cell").distinct(), "cell", "left_semi")
    return rows.groupBy("cell", "chrom", "pos").agg(F.sum("n").alias("n"))


def group_matrix(merged: DataFrame, groups: list[str] | None = None, chroms: list[str] | None = None) -> DataFrame:
    """A pre-merged group x base matrix as coverage rows (pid, chrom, pos, n) of some groups and chromosomes; a group that
    is not there is an error."""
    rows = merged if chroms is None else merged.filter(F.col("chrom").isin(list(chroms)))
    if groups is None:
        return rows
    missing = set(groups) - {r["pid"] for r in merged.filter(F.col("pid").isin(list(groups))).select("pid").distinct().collect()}
    if missing:
        raise KeyError(f"groups not in the matrix: {sorted(missing)}")
    return rows.filter(F.col("pid").isin(list(groups)))


def meta_regions(regions: DataFrame, width: int) -> DataFrame:
    """regions with `meta`, the window "chrom:start-end" that spans all regions of their bin on a coarse grid, and their place in
    it: meta_start, rel_start, rel_end. A region's bin is that of the end of it that more of it lies at (meta_bin)."""
    own = regions.withColumn("_meta", meta_bin(F.col("start"), F.col("end"), width))
    spans = own.groupBy("chrom", "_meta").agg(F.min("start").alias("meta_start"), F.max("end").alias("_end"))
    placed = own.join(spans, ["chrom", "_meta"]).withColumn("meta", format_region(F.col("chrom"), F.col("meta_start"), F.col("_end")))
    return placed.withColumns({"rel_start": F.col("start") - F.col("meta_start"), "rel_end": F.col("end") - F.col("meta_start")}).select(*regions.columns, "meta", "meta_start", "rel_start", "rel_end")


def meta_signal(regions: DataFrame, points: DataFrame, width: int, keys: tuple[str, ...] = (), pos: str = "pos", value: str = "n") -> DataFrame:
    """(meta, keys, offset, value): the tracks of all regions of a meta-region laid into it; positions that no region covers are
    not rows, and a position in several of its regions is one. points: chrom, pos, value, and keys that tell tracks apart."""
    placed = meta_regions(regions.select("chrom", "start", "end").distinct(), width)
    summed = points.groupBy("chrom", pos, *keys).agg(F.sum(value).alias("value")).withColumns({"start": F.col(pos), "end": F.col(pos) + 1})
    hits = overlap(placed.select("chrom", "start", "end", "meta", "meta_start"), summed, fitting_width(placed), "_p")
    columns = ["meta", *[F.col(f"{k}_p").alias(k) for k in keys], (F.col(f"{pos}_p") - F.col("meta_start")).alias("offset"), F.col("value_p").alias("value")]
    return hits.select(*columns).distinct()
