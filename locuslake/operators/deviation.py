"""Motif deviation scores of cells over matched background peaks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.functions.sequences import base_counts
from locuslake.operators.checks import small
from locuslake.operators.sampling import uniform
from locuslake.sources.store import park


def composition(seqs: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, n_a, n_c, n_g, n_t, gc): base counts, and the share of G and C among counted bases."""
    c = seqs.select(key, *base_counts(F.col(seq)))
    return c.withColumn("gc", F.try_divide((F.col("n_g") + F.col("n_c")).cast("double"), F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")))


def expected_counts(counts: DataFrame) -> DataFrame:
    """(cell, feature, expected): a cell's share of all counts times the feature's total; every cell meets every feature
    by definition, so that it is for a chosen set of features. deviations() does without it."""
    cells = counts.groupBy("cell").agg(F.sum("n").alias("c"))
    features = counts.groupBy("feature").agg(F.sum("n").alias("f"))
    total = cells.agg(F.sum("c").alias("t"))
    return cells.crossJoin(F.broadcast(total)).join(features, F.lit(True)).select("cell", "feature", (F.col("c") * F.col("f") / F.col("t")).alias("expected"))


#: Most cells, features and motifs of a tile, and tiles' rows handed to Python at once (some hundred kilobytes each).
CELLS, FEATURES, MOTIFS, TILES_AT_ONCE = 4096, 1024, 16, 32
#: Entries of sets that a task packs at once.
ENTRIES = 2_000_000


def deviations(counts: DataFrame, matches: DataFrame, background: DataFrame) -> DataFrame:
    """(cell, motif, z): how far a cell's counts in a motif's peaks exceed those in background peaks.

    counts: cell, feature, n; matches: motif, feature; background: feature, iter, bg_feature. The raw score d is
    (observed - expected) / expected, 0 without expectation; z subtracts the mean of the background's scores and
    divides by their population deviation; with no deviation (under 1e-7) it is 0 for a difference of 0, else null.

    Observed counts are a product of sparse matrices: cells by features times features by sets, a set being a motif and
    an iteration. It is made in blocks: a task has some cells and some motifs, gets the blocks of both matrices feature
    block by feature block, and keeps its sums, so that neither counts nor products are repeated for each set in any
    shuffle. Rows that are shuffled are the entries of both matrices, and their blocks once for each task that needs them;
    blocks of sets hold two bytes for an entry, and there are as many blocks of cells as memory and the cores ask for.
    """
    spark = counts.sparkSession
    counts = counts.filter("cell is not null and feature is not null").groupBy("cell", "feature").agg(F.sum("n").cast("double").alias("n"))
    counts = park(counts, "counts")
    size = counts.agg(F.approx_count_distinct("cell").alias("cells"), F.approx_count_distinct("feature").alias("features"), F.sum("n").alias("all")).first()
    # features outside the counts stand in sets, too
    n_motifs, iterations = matches.agg(F.approx_count_distinct("motif")).first()[0], (background.agg(F.max("iter")).first()[0] or 0) + 1
    tasks = 2 * spark.sparkContext.defaultParallelism
    n_cells = max(1, -(-size["cells"] // CELLS), min(tasks, size["cells"] // 128))
    n_features, n_motif_blocks = max(1, -(-size["features"] // FEATURES)), max(1, -(-n_motifs // MOTIFS))
    block = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    own = matches.select("motif", F.lit(0).alias("set"), "feature")
    drawn = background.join(matches.hint("shuffle_hash"), "feature").select("motif", (F.col("iter") + 1).cast("int").alias("set"), F.col("bg_feature").alias("feature"))
    sets = park(_packed(own.unionByName(drawn).filter("feature is not null"), block("feature", n_features, "fb"), block("motif", n_motif_blocks, "mb"), iterations + 1), "sets")
    sets = sets.select(every(n_cells, "cb"), "mb", "fb", F.lit(2).alias("kind"), "feature", F.array("motif").alias("motif"), "times", "sets")
    totals = counts.groupBy("feature").agg(F.sum("n").alias("n")).groupBy(block("feature", n_features, "fb")).agg(F.collect_list(F.struct("feature", "n")).alias("x"))
    totals = totals.select(every(n_cells, "cb"), "fb", "x").select("cb", every(n_motif_blocks, "mb"), "fb", F.lit(1).alias("kind"), F.col("x.feature").alias("feature"), F.col("x.n").alias("n"))
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n")).groupBy(block("cell", n_cells, "cb")).agg(F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("x"))
    cells = cells.select("cb", every(n_motif_blocks, "mb"), F.lit(-1).alias("fb"), F.lit(0).alias("kind"), F.col("x.cell").alias("cell"), F.col("x.n").alias("n"))
    tiles = counts.groupBy(block("cell", n_cells, "cb"), block("feature", n_features, "fb")).agg(F.collect_list(F.struct("cell", "feature", "n")).alias("x"))
    tiles = tiles.select("cb", every(n_motif_blocks, "mb"), "fb", F.lit(3).alias("kind"), F.col("x.cell").alias("cell"), F.col("x.feature").alias("feature"), F.col("x.n").alias("n"))
    parts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [cells, totals, sets, tiles])
    parts = parts.repartition(4 * min(tasks, n_cells * n_motif_blocks), "cb", "mb").sortWithinPartitions("cb", "mb", "fb", "kind")
    schema = f"cell {dict(counts.dtypes)['cell']}, motif {dict(matches.dtypes)['motif']}, z double"
    scored = parts.select("cb", "mb", "kind", "cell", "feature", "motif", "times", "sets", "n").mapInPandas(_scorer(iterations + 1, size["all"] or 0.0), schema)
    with batches_of(spark, TILES_AT_ONCE):
        return park(scored, "deviations")


def _packed(entries: DataFrame, fb: Column, mb: Column, n_sets: int, most: int = ENTRIES) -> DataFrame:
    """(fb, mb, motif, feature, times, sets): entries (feature, motif, set) of a motif in a feature block, as features, how
    many entries each has, and these entries' sets as bytes. A block may have several rows; a task packs about `most` entries at once."""
    kinds, width = dict(entries.dtypes), _set_type(n_sets)

    def rows_of(batches: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        motif, motifs = pd.factorize(rows["motif"], use_na_sentinel=False)
        feature, features = pd.factorize(rows["feature"])
        blocks = rows[["fb", "mb"]].to_numpy()
        own = np.zeros(len(features), np.int64)
        own[feature] = blocks[:, 0]
        motif_block = np.zeros(len(motifs), np.int64)
        motif_block[motif] = blocks[:, 1]
        # features in the order of their blocks, so that one number orders block, motif, feature and set
        rank = np.argsort(own, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        block_ids, block_at = np.unique(own, return_inverse=True)
        key = np.sort(((block_at[feature] * len(motifs) + motif) * len(features) + place[feature]) * n_sets + rows["set"].to_numpy())
        sets, pair = (key % n_sets).astype(width), key // n_sets
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        times, group = np.diff(starts, append=len(pair)), pair[starts] // len(features)
        found = np.asarray(features)[rank][pair[starts] % len(features)]
        edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(group)]
        for lo in range(0, len(edges) - 1, 64):
            some = list(zip(edges[lo : lo + 64], edges[lo + 1 : lo + 65], strict=False))
            at = np.array([group[a] for a, _ in some])
            ends = [(starts[a], starts[b] if b < len(starts) else len(pair)) for a, b in some]
            names = motifs[at % len(motifs)]
            yield pd.DataFrame({
                "fb": block_ids[at // len(motifs)], "mb": motif_block[at % len(motifs)], "motif": names,
                "feature": [found[a:b] for a, b in some], "times": [times[a:b] for a, b in some], "sets": [sets[x:y].tobytes() for x, y in ends],
            })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= most:
                yield from rows_of(held)
                held, n = [], 0
        if n:
            yield from rows_of(held)

    dealt = entries.select(fb, mb, "feature", "motif", "set").repartition("fb")
    return dealt.mapInPandas(pack, f"fb int, mb int, motif {kinds['motif']}, feature array<{kinds['feature']}>, times array<int>, sets binary")


def _set_type(n_sets: int) -> type:
    return np.uint16 if n_sets <= 1 << 16 else np.uint32


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it Python tasks get so many rows at once; for rows that hold whole blocks. Results must be stored inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Sums:
    """What a task adds up for its cells: for each motif the counts of cells in sets, the sets' totals, and which sets there are."""

    def __init__(self, cells: np.ndarray, totals: np.ndarray, n_sets: int):
        self.cells, self.totals, self.n_sets = cells, totals, n_sets
        self.observed: dict = {}
        self.set_totals: dict = {}
        self.present: dict = {}
        self.features, self.weights = np.empty(0), {}

    def open_block(self, features: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(features)
        self.features, self.feature_totals, self.weights = features[order], n[order], {}

    def add_sets(self, features: np.ndarray, motif: object, times: np.ndarray, sets: np.ndarray) -> None:
        """Entries of a motif in the open block: the sets of each feature, one after another."""
        at = np.minimum(np.searchsorted(self.features, features), max(len(self.features) - 1, 0))
        counted = self.features[at] == features if len(self.features) else np.zeros(len(features), bool)
        if motif not in self.observed:
            self.observed[motif] = np.zeros((len(self.cells), self.n_sets))
            self.set_totals[motif], self.present[motif] = np.zeros(self.n_sets), np.zeros(self.n_sets, bool)
        self.present[motif][sets] = True
        own = np.repeat(counted, times)
        entries = np.repeat(at, times)[own] * self.n_sets + sets[own]
        weights = np.bincount(entries, minlength=len(self.features) * self.n_sets).reshape(-1, self.n_sets).astype(float)
        self.set_totals[motif] += self.feature_totals @ weights if len(self.features) else 0.0
        self.weights[motif] = self.weights[motif] + weights if motif in self.weights else weights

    def add_counts(self, cells: np.ndarray, features: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(cells, kind="stable")
        row, at, n = np.searchsorted(self.cells, cells[order]), np.searchsorted(self.features, features[order]), n[order]
        for k in range(0, len(n), 4096):
            r, a, v = row[k : k + 4096], at[k : k + 4096], n[k : k + 4096, None]
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            for motif, weights in self.weights.items():
                self.observed[motif][r[starts]] += np.add.reduceat(weights[a] * v, starts)

    def scores(self, all_counts: float) -> Iterator[pd.DataFrame]:
        for motif, observed in self.observed.items():
            expected = self.totals[:, None] * self.set_totals[motif] / all_counts
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(expected > 0, (observed - expected) / expected, 0.0)
                drawn = d[:, 1:][:, self.present[motif][1:]]
                diff = d[:, 0] - (drawn.mean(1) if drawn.shape[1] else np.nan)
                spread = drawn.std(1) if drawn.shape[1] else np.zeros(len(d))
                z = np.where(spread > 1e-7, diff / spread, np.where(np.abs(diff) < 1e-7, 0.0, np.nan))
            yield pd.DataFrame({"cell": self.cells, "motif": motif, "z": pd.array(z, "Float64")})


def _scorer(n_sets: int, all_counts: float):
    """The task: blocks in the order of cells, then for each feature block its totals, sets and counts."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sums = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if at != (row.cb, row.mb):
                    if sums is not None:
                        yield from sums.scores(all_counts)
                    at, sums = (row.cb, row.mb), None
                if row.kind == 0:
                    sums = _Sums(np.asarray(row.cell), np.asarray(row.n), n_sets)
                elif sums is None:
                    continue  # no cell has this block
                elif row.kind == 1:
                    sums.open_block(np.asarray(row.feature), np.asarray(row.n))
                elif row.kind == 2:
                    sums.add_sets(np.asarray(row.feature), row.motif[0], np.asarray(row.times), np.frombuffer(row.sets, _set_type(n_sets)).astype(np.int64))
                else:
                    sums.add_counts(np.asarray(row.cell), np.asarray(row.feature), np.asarray(row.n))
        if sums is not None:
            yield from sums.scores(all_counts)

    return score


def whiten(peaks: DataFrame, x: str, y: str) -> DataFrame:
    """peaks with wx, wy: two measures centred and decorrelated by the Cholesky factor of their covariance."""
    m = peaks.agg(F.avg(x), F.avg(y), F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)).first()
    a = np.sqrt(m[2])
    b = m[3] / a
    c = np.sqrt(m[4] - b * b)
    wx = (F.col(x) - m[0]) / F.lit(float(a))
    return peaks.withColumn("wx", wx).withColumn("wy", (F.col(y) - m[1] - F.lit(float(b)) * wx) / F.lit(float(c)))


def grid_bins(peaks: DataFrame, bins: int) -> DataFrame:
    """peaks with bin: the nearest point of a regular bins x bins grid over wx and wy."""
    e = peaks.agg(F.min("wx"), F.max("wx"), F.min("wy"), F.max("wy")).first()
    at = lambda c, lo, hi: F.round((F.col(c) - lo) / ((hi - lo) or 1.0) * (bins - 1)).cast("int")
    return peaks.withColumn("bin", at("wx", e[0], e[1]) * bins + at("wy", e[2], e[3]))


def background_peaks(peaks: DataFrame, iterations: int, bins: int = 50, width: float = 0.1, seed: int = 0, x: str = "log_depth", y: str = "gc") -> DataFrame:
    """(feature, iter, bg_feature): peaks alike in depth and GC, drawn with replacement.

    A peak's partner comes from a grid bin drawn by a Gaussian of the bins' distance times the bin's count, then
    evenly from that bin. Bins (at most bins^2) are weighed on the driver; draws are equi-joins. The table of weights has
    a row for each bin and each SLOTS-th of (0, 1), with the few sums of weights that lie in it, of bins within some
    eight widths; it is broadcast where its entries are few enough. Peaks are dealt out before draws are made of them.
    """
    g = park(grid_bins(whiten(park(peaks.select("feature", x, y), "peaks"), x, y), bins).select("feature", "wx", "wy", "bin"), "bins")
    held = g.groupBy("bin").agg(F.count("*").alias("n"), F.avg("wx").alias("x"), F.avg("wy").alias("y")).orderBy("bin").toPandas()
    xy, n = held[["x", "y"]].to_numpy(), held["n"].to_numpy()
    w = np.exp(-((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2) / (2 * width**2)) * n[None, :]
    cdf = np.cumsum(w / w.sum(axis=1, keepdims=True), axis=1)
    # targets whose weight is lost in the sum's last bit are never drawn: a few hundred of a row are left
    seen = np.diff(cdf, axis=1, prepend=0.0) > 0
    rows = [(int(held["bin"][i]), *slot) for i in range(len(held)) for slot in _slots(cdf[i][seen[i]], held["bin"].to_numpy()[seen[i]])]
    spark = peaks.sparkSession
    table = spark.createDataFrame(rows, "bin int, slot int, cdf array<double>, to array<int>")
    dealt = g.select("feature", "bin").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n.sum()) * iterations // DRAWS)), "feature")
    u = uniform(seed, F.col("feature"), F.col("iter"))
    draws = dealt.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("u", u).withColumn("slot", F.floor(F.col("u") * SLOTS).cast("int"))
    draws = draws.join(small(table, n=len(rows) + int(seen.sum())), ["bin", "slot"])
    at = F.least(F.size(F.filter("cdf", lambda c: c <= F.col("u"))), F.size("to") - 1)
    draws = draws.withColumn("to_bin", F.get("to", at)).select("feature", "iter", "to_bin")
    ranked = g.select(F.col("bin").alias("to_bin"), F.col("feature").alias("bg_feature"), (F.row_number().over(W.partitionBy("bin").orderBy("feature")) - 1).alias("k"))
    sizes = g.groupBy(F.col("bin").alias("to_bin")).agg(F.count("*").alias("m"))
    k = F.floor(uniform(seed + 1, F.col("feature"), F.col("iter")) * F.col("m"))
    drawn = draws.join(small(sizes, n=len(held)), "to_bin").withColumn("k", k.cast("int"))
    # draws are many for each peak: they are not sorted to find it
    return drawn.join(ranked.hint("shuffle_hash"), ["to_bin", "k"]).select("feature", "iter", "bg_feature")


#: Parts of (0, 1) by which draws find their place in the sums of weights (a power of two), and draws of a task.
SLOTS, DRAWS = 64, 2_000_000


def _slots(cdf: np.ndarray, to: np.ndarray) -> Iterator[tuple[int, list[float], list[int]]]:
    """(slot, sums of weights inside of it, targets): a draw in the slot has the target numbered by the sums not above it."""
    first = np.searchsorted(cdf, np.arange(SLOTS) / SLOTS, side="right")
    last = np.searchsorted(cdf, np.arange(1, SLOTS + 1) / SLOTS, side="left")
    for slot, (a, b) in enumerate(zip(first, last, strict=True)):
        yield slot, cdf[a:b].tolist(), to[min(a, len(to) - 1) : b + 1].tolist()


def standardize_scores(scores: DataFrame, group: list[str], value: str = "z") -> DataFrame:
    """scores with `standard`: z-score of the value in its group."""
    w = W.partitionBy(*group)
    return scores.withColumn("standard", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))
