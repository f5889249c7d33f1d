"""Readers and writers of the text formats around the store. All but small dimension files are read by Spark tasks."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAIN_CHROM = r"^(chr)?([0-9]+|X|Y|M)$"


def read_chrom_sizes(spark: SparkSession, path: str, main: bool = True) -> DataFrame:
    """(chrom, size) in order of names; main: only numbered chromosomes, X, Y and M."""
    rows = spark.read.schema("chrom string, size long").csv(path, sep="\t", comment="#")
    return (rows.filter(F.col("chrom").rlike(MAIN_CHROM)) if main else rows).orderBy("chrom")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a headerless BED file of three columns or more; a missing name is the region's string form."""
    rows = spark.read.schema("chrom string, start long, end long, name string, score string, strand string").csv(path, sep="\t", comment="#", mode="PERMISSIVE")
    name = F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return rows.filter("start is not null").select("chrom", "start", "end", F.coalesce("name", name).alias("name"), "strand")


def write_bed(regions: DataFrame, path: str) -> None:
    """Regions ordered along the genome as tab-separated text."""
    columns = [c for c in ("chrom", "start", "end", "name", "score", "strand") if c in regions.columns]
    regions.select(columns).repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").csv(path, sep="\t")


def read_fragments(spark: SparkSession, path: str, sample: str, least: int = 200, whitelist: DataFrame | None = None) -> DataFrame:
    """Fragments (chrom, start, end, cell, count, strand, sample) of cells with at least `least`; plain or gzipped text."""
    from locuslake.operators.coverage import enough_fragments

    rows = spark.read.schema("chrom string, start long, end long, cell string, count int, strand string").csv(path, sep="\t", comment="#")
    return enough_fragments(rows, least, whitelist).withColumn("sample", F.lit(sample)).withColumn("frag_path", F.lit(path))


def read_bedgraph(spark: SparkSession, path: str, track: str | None = None) -> DataFrame:
    """(chrom, start, end, value[, track]); missing values are 0."""
    rows = spark.read.schema("chrom string, start long, end long, value double").csv(path, sep="\t", comment="#").fillna(0.0, ["value"])
    return rows if track is None else rows.withColumn("track", F.lit(track))


def read_tracks(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Named tracks together; names are the row ids, so that none may come twice."""
    from functools import reduce

    if len(set(paths.values())) != len(paths):
        raise ValueError("a track file is named twice")
    return reduce(lambda a, b: a.unionByName(b), [read_bedgraph(spark, p, k) for k, p in paths.items()])


def write_bedgraph(bins: DataFrame, path: str, resolution: int) -> None:
    """Non-zero bins (chrom, bin, value) as an ordered bedGraph."""
    rows = bins.filter("value <> 0").select("chrom", (F.col("bin") * resolution).alias("start"), ((F.col("bin") + 1) * resolution).alias("end"), "value")
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").csv(path, sep="\t")


def read_methylation(spark: SparkSession, path: str, context: str, resolution: int) -> DataFrame:
    """(chrom, bin, prefix, value) with prefixes {context}_mc and {context}_cov, from per-cytosine calls with one-based
    positions; the context is an IUPAC pattern that the call's context starts with."""
    from locuslake.functions.sequences import iupac_pattern

    rows = spark.read.schema("chrom string, pos long, strand string, context string, mc long, cov long, flag int").csv(path, sep="\t", comment="#")
    rows = rows.filter(F.col("context").rlike(f"^{iupac_pattern(context)}"))
    both = F.explode(F.array(F.struct(F.lit(f"{context}_mc").alias("prefix"), F.col("mc").alias("v")), F.struct(F.lit(f"{context}_cov").alias("prefix"), F.col("cov").alias("v"))))
    return rows.select("chrom", F.floor((F.col("pos") - 1) / resolution).alias("bin"), both.alias("x")).groupBy("chrom", "bin", "x.prefix").agg(F.sum("x.v").alias("value"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, source, feature_type, start, end, strand, gene_id, gene_name, transcript_id, attributes), 0-based."""
    rows = spark.read.schema("chrom string, source string, feature_type string, start long, end long, score string, strand string, frame string, attribute string").csv(path, sep="\t", comment="#", quote="")
    of = lambda k: F.nullif(F.regexp_extract("attribute", rf'(?:^|;\s*){k} "([^"]*)"', 1), F.lit(""))
    pairs = F.filter(F.transform(F.split("attribute", ";"), lambda x: F.regexp_extract_all(x, F.lit(r'(\S+) "([^"]*)"'), 0)), lambda x: F.size(x) > 0)
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(F.get(x, F.lit(0)), r'(\S+) "', 1).alias("key"), F.regexp_extract(F.get(x, F.lit(0)), r'"([^"]*)"', 1).alias("value")))
    return rows.select("chrom", "source", "feature_type", (F.col("start") - 1).alias("start"), "end", "strand", of("gene_id").alias("gene_id"), of("gene_name").alias("gene_name"), of("transcript_id").alias("transcript_id"), F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])).alias("attributes"))


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, at, seq): the sequence lines of FASTA files, each with its first base's place in its record.

    However the files are split over tasks, a line has a file, the byte at which its split begins and an ascending id in
    it. Places are sums over two levels: inside a split, and over a file's splits, of which only the bases after the last
    header and that header's name are carried on. Headers are names up to a space; each should occur once.
    """
    block = ["_file", "_block"]
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), F.rtrim("value").alias("value")
    )
    is_head = F.col("value").startswith(">")
    name = F.when(is_head, F.regexp_extract("value", r"^>\s*(\S*)", 1))
    here = W.partitionBy(*block).orderBy("_line")
    lines = lines.withColumns({"_name": F.last(name, ignorenulls=True).over(here), "_heads": F.sum(is_head.cast("long")).over(here), "_n": F.when(is_head, 0).otherwise(F.length("value"))})
    record = W.partitionBy(*block, "_heads").orderBy("_line").rowsBetween(W.unboundedPreceding, -1)
    placed = lines.withColumn("_in", F.coalesce(F.sum("_n").over(record), F.lit(0)))
    ends = lines.groupBy(*block).agg(F.max("_heads").alias("_heads"), F.max_by("_name", "_line").alias("_name"))
    tails = lines.groupBy(*block, "_heads").agg(F.sum("_n").alias("_tail")).join(ends, [*block, "_heads"])  # a row for each split
    along = W.partitionBy("_file").orderBy("_block")
    tails = tails.withColumn("_run", F.sum((F.col("_heads") > 0).cast("long")).over(along))
    tails = tails.withColumn("_open", F.sum("_tail").over(W.partitionBy("_file", "_run").orderBy("_block"))).withColumn("_owner", F.last("_name", ignorenulls=True).over(along))
    carried = tails.select(*block, F.lag("_open").over(along).alias("_open"), F.lag("_owner").over(along).alias("_owner"))
    first = F.col("_heads") == 0
    out = placed.filter(~is_head & (F.col("_n") > 0)).join(carried, block)
    return out.select(F.when(first, F.col("_owner")).otherwise(F.col("_name")).alias("chrom"), (F.col("_in") + F.when(first, F.coalesce("_open", F.lit(0))).otherwise(0)).alias("at"), F.col("value").alias("seq"))


def read_fasta(spark: SparkSession, path: str, tile: int = 1_000_000, slop: int = 0) -> DataFrame:
    """(chrom, tile_start, tile_end, seq_start, seq): FASTA files as tiles that each own [tile_start, tile_end) and hold slop
    bases more on both sides, as far as the chromosome goes.

    A line is cut where it crosses the border of what a tile holds, so that no task ever holds a whole chromosome. Bases
    before a file's first header are left out.
    """
    lines = fasta_lines(spark, path).filter("chrom is not null")
    end = F.col("at") + F.length("seq")
    t = F.explode(F.sequence(F.greatest(F.floor((F.col("at") - slop) / tile), F.lit(0)), F.floor((end - 1 + slop) / tile)))
    cut = lines.withColumn("t", t)
    lo, hi = F.col("t") * tile - slop, (F.col("t") + 1) * tile + slop
    first, last = F.greatest(F.col("at"), lo), F.least(end, hi)
    piece = F.substr("seq", (first - F.col("at") + 1).cast("int"), (last - first).cast("int"))
    found = cut.groupBy("chrom", "t").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), piece.alias("p")))).alias("pieces"))
    seq = F.array_join(F.transform("pieces", lambda x: x["p"]), "")
    begin = F.get("pieces", F.lit(0))["at"]
    tiles = found.select("chrom", (F.col("t") * tile).alias("tile_start"), begin.alias("seq_start"), seq.alias("seq"))
    stop = F.least(F.col("tile_start") + tile, F.col("seq_start") + F.length("seq"))
    # past the chromosome's end there is slop only
    return tiles.select("chrom", "tile_start", stop.alias("tile_end"), "seq_start", "seq").filter("tile_end > tile_start")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(motif_id, name, pos, a, c, g, t) of PFM text files: '>id name', then four rows of counts in order ACGT, with or
    without the base's letter and brackets. A record is a row, so that files of any number and size are read in parallel."""
    records = spark.read.option("lineSep", ">").text(path).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("lines")).filter(F.size("lines") > 0)
    head = F.split(F.trim(F.get("lines", F.lit(0))), r"\s+")
    numbers = lambda k: F.regexp_extract_all(F.get("lines", F.lit(k)), F.lit(r"[-+]?[0-9][-+.eE0-9]*"), F.lit(0)).cast("array<double>")
    rows = records.select(F.get(head, F.lit(0)).alias("motif_id"), F.coalesce(F.get(head, F.lit(1)), F.get(head, F.lit(0))).alias("name"), *[numbers(k + 1).alias(b) for k, b in enumerate("acgt")])
    same = (F.size("a") == F.size("c")) & (F.size("a") == F.size("g")) & (F.size("a") == F.size("t"))
    checked = rows.withColumn("a", F.when(same, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("rows of unequal length in motif "), "motif_id")).cast("array<double>")))
    return checked.select("motif_id", "name", F.posexplode(F.arrays_zip("a", "c", "g", "t")).alias("pos", "x")).select("motif_id", "name", "pos", "x.a", "x.c", "x.g", "x.t")


def instances(hits: DataFrame, chrom: str, start: int, end: int, genes: list[str] | None = None) -> DataFrame:
    """Stored motif instances inside a region, of some genes only if asked."""
    rows = hits.filter((F.col("chrom") == chrom) & (F.col("start") >= start) & (F.col("end") <= end))
    return rows if genes is None else rows.filter(F.col("gene").isin(genes))


def decode_blobs(store: DataFrame, prefix: str, resolution: int) -> DataFrame:
    """(region, row_id, bin, value): non-zero cells of gzipped matrices in columns prefix:part+dtype.

    Sparse ones have indices, indptr, data and shape; dense ones data and shape only. Bins count from the window's start.
    """
    columns = {c.split(":")[1].split("+")[0]: c for c in store.columns if c.startswith(f"{prefix}:")}
    dtypes = {part: c.rpartition("+")[2] for part, c in columns.items()}
    plain = store.select("region", *[F.col(f"`{c}`").alias(part) for part, c in columns.items()])

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                a = {p: np.frombuffer(gzip.decompress(record[p]), dtypes[p]) for p in columns if record[p] is not None}
                rows, width = (int(x) for x in a["shape"])
                if "indptr" in a:
                    row, at, data = np.repeat(np.arange(rows), np.diff(a["indptr"])), a["indices"], a["data"]
                else:
                    dense = a["data"].reshape(rows, width)
                    row, at = np.nonzero(dense)
                    data = dense[row, at]
                yield pd.DataFrame({"region": record["region"], "row_id": row.astype(np.int32), "bin": at.astype(np.int64), "value": data.astype(float)})

    return plain.mapInPandas(decode, "region string, row_id int, bin long, value double")


def write_region_matrix(rows: DataFrame, path: str, span: int = 50_000_000) -> None:
    """Region-track means by chromosome and stretch of `span` bases."""
    rows.withColumn("partition", F.concat_ws("-", "chrom", F.floor(F.col("start") / span).cast("string"))).write.mode("overwrite").partitionBy("partition").parquet(path)


def write_results(rows: DataFrame, path: str, wide_by: str | None = None, key: str | None = None, value: str | None = None) -> None:
    """A result table, long, or wide with a column for each value of wide_by."""
    out = rows if wide_by is None else rows.groupBy(key).pivot(wide_by).agg(F.first(value))
    out.write.mode("overwrite").parquet(path)


def write_sidecars(path: str, names: DataFrame, config: DataFrame) -> None:
    """Writes the row names (dataset, prefix, row_id, name) and the settings (dataset, key, value) beside a store."""
    names.write.mode("overwrite").parquet(f"{path}/row_names")
    config.coalesce(1).write.mode("overwrite").json(f"{path}/config")


def read_row_names(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """(dataset, prefix, row_id, name) of a store, of one prefix if that is given."""
    names = spark.read.parquet(f"{path}/row_names")
    return names if prefix is None else names.filter(F.col("prefix") == prefix)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, key, value) of a store's settings."""
    return spark.read.schema("dataset string, key string, value string").json(f"{path}/config")


#: Readers of coverage by name: (spark, options) -> rows with the columns of COVERAGE.
READERS: dict = {}
COVERAGE = {"prefix": "string", "chrom": "string", "bin": "bigint", "row_id": "", "value": ""}


def register_reader(name: str, reader) -> None:
    """Adds a source: a function of (spark, options) that gives coverage rows."""
    READERS[name] = reader


def read_source(spark: SparkSession, name: str, **options) -> DataFrame:
    """Coverage of a registered source; rows of another form are an error."""
    from locuslake.operators.checks import require_columns

    return require_columns(READERS[name](spark, options), COVERAGE).select(*COVERAGE)
