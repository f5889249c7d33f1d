"""Cells, metacells and groups: votes, sums, centroids, purity, depth-matched neighbourhoods, splits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.operators.checks import small
from locuslake.operators.ordered import quantiles, running
from locuslake.sources.store import park


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value): the commonest value of each group, the smallest on ties; nulls don't vote."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value))


def purity(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, purity): share of the commonest value."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg((F.max("n") / F.sum("n")).alias("purity"))


def summarize(rows: DataFrame, group: str, rules: dict[str, str]) -> DataFrame:
    """One row per group; rules: column -> 'mode', 'sum', 'mean', 'min', 'max' or 'count'."""
    plain = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    out = rows.groupBy(group).agg(F.count("*").alias("n_members"), *[plain[r](c).alias(c) for c, r in rules.items() if r != "mode"])
    for c in (c for c, r in rules.items() if r == "mode"):
        out = out.join(majority(rows, group, c), group, "left")
    return out


def aggregate_terms(rows: DataFrame, group: str, term: str, rule: Callable[[Column], Column] = F.avg) -> DataFrame:
    """A term's values per group, the mean unless told otherwise; a null or NaN among them is an error."""
    bad = F.col(term).isNull() | F.isnan(F.col(term).cast("double"))
    checked = F.when(bad, F.raise_error(F.lit(f"missing value in {term}")).cast("double")).otherwise(F.col(term).cast("double"))
    return rows.select(group, checked.alias(term)).groupBy(group).agg(rule(F.col(term)).alias(term))


def member_lists(rows: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members): sorted members; groups are of bounded size by construction (metacells)."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias("members"))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean): element-wise mean vector, summed in parallel for each element."""
    long = rows.select(group, F.posexplode(vector).alias("dim", "v")).groupBy(group, "dim").agg(F.avg("v").alias("v"))
    return long.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("mean"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def representatives(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key): the member nearest to the group's mean, the smallest key on ties."""
    j = rows.join(mean_vectors(rows, group, vector), group).withColumn("_d", F.round(squared_distance(F.col(vector).cast("array<double>"), F.col("mean")), 9))
    return j.groupBy(group).agg(F.min_by(key, F.struct("_d", F.col(key).alias("k"))).alias(key))


def rare_weights(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, weight): 1 / sqrt(n), adding up to 1."""
    n = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("_w", 1 / F.sqrt("n"))
    whole = n.agg(F.sum("_w").alias("_all"))
    return n.crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_w") / F.col("_all")).drop("_w", "_all")  # the sum is one row


def share(rows: DataFrame, group: list[str], value: str, out: str = "share") -> DataFrame:
    """rows with value / its sum over the group."""
    return rows.withColumn(out, F.col(value) / F.sum(value).over(W.partitionBy(*group)))


def dataset_draws(datasets: DataFrame, n: int, weight: str = "weight") -> DataFrame:
    """datasets with weight / the largest weight, and draws = max(1, whole part of n times it)."""
    top = datasets.crossJoin(F.broadcast(datasets.agg(F.max(weight).alias("_top")))).withColumn("relative", F.col(weight) / F.col("_top")).drop("_top")  # one row
    return top.withColumn("draws", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(n) * F.col("relative"))))


def grow_to_depth(ranked: DataFrame, group: str, order: list[Column], size: str, target: float, most: int = 128) -> DataFrame:
    """Rows of each group up to where the running size is closest to the target, at most `most`. Earliest on ties."""
    w = W.partitionBy(group).orderBy(*order)
    r = ranked.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    r = r.withColumn("cum", F.sum(size).over(W.partitionBy(group).orderBy("rn").rowsBetween(W.unboundedPreceding, 0)))
    cut = F.min(F.struct(F.abs(F.col("cum") - target).alias("gap"), F.col("rn").alias("at"))).over(W.partitionBy(group))
    return r.withColumn("_cut", cut["at"]).filter(F.col("rn") <= F.col("_cut")).drop("_cut")


def depth_matched(members: DataFrame, seeds: DataFrame, group: str, key: str, vector: str, size: str, target: float, most: int = 128) -> DataFrame:
    """Pseudobulks grown around seeds: (seed, key, rn, cum), members of the seed's group from the nearest on.

    seeds: group, seed, seed_vector; a bounded number for each group.
    """
    j = members.join(seeds, group).withColumn("_d", F.round(squared_distance(F.col(vector).cast("array<double>"), F.col("seed_vector").cast("array<double>")), 6))
    return grow_to_depth(j, "seed", [F.col("_d"), F.col(key)], size, target, most).select("seed", group, key, "rn", "cum")


def split_by_cap(rows: DataFrame, group: str, size: str, cap: float, key: str, seed: int = 0) -> DataFrame:
    """rows with part: a group is dealt in hash order to ceil(total / cap) parts, round robin."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    total = rows.groupBy(group).agg(F.ceil(F.sum(size) / cap).cast("long").alias("_parts"))
    ranked = running(rows.withColumns({"_h": h, "_one": F.lit(1)}), [group], ["_h", key], "_one", "_rank", "_n")
    return ranked.join(total, group).withColumn("part", F.pmod(F.col("_rank"), F.greatest("_parts", F.lit(1)))).drop("_parts", "_h", "_one", "_rank", "_n")


def log_normalize(counts: DataFrame, cell: str, n: str, total: float = 1e4) -> DataFrame:
    """counts with value = log1p(n / the cell's sum * total)."""
    return counts.withColumn("value", F.log1p(F.col(n) / F.sum(n).over(W.partitionBy(cell)) * total))


def feature_filter(counts: DataFrame, feature: str, n: str, low: float = 0.05, high: float = 0.997) -> DataFrame:
    """(feature, total) of features whose total lies strictly between two quantiles of the totals."""
    totals = counts.groupBy(feature).agg(F.sum(n).alias("total"))
    totals = park(totals)
    edges = quantiles(totals, [], "total", [low, high])
    return totals.crossJoin(F.broadcast(edges)).filter("total > q0 and total < q1").drop("q0", "q1")  # edges is one row


def top_features(counts: DataFrame, feature: str, n: str, least: float, most: int) -> DataFrame:
    """(feature, total) over a least total, at most `most` of the largest; the smallest name on ties."""
    totals = counts.groupBy(feature).agg(F.sum(n).alias("total")).filter(F.col("total") > least)
    return totals.orderBy(F.desc("total"), feature).limit(most)


def without_outliers(rows: DataFrame, columns: list[str], quantile: float = 0.99, factor: float = 2.0) -> DataFrame:
    """rows below factor times the quantile in each column."""
    kept = rows
    for k, c in enumerate(columns):
        edge = quantiles(rows.select(c), [], c, [quantile]).select((F.col("q0") * factor).alias(f"_edge{k}"))
        kept = kept.crossJoin(F.broadcast(edge)).filter(F.col(c) < F.col(f"_edge{k}"))  # one row
    return kept.select(rows.columns)


def _split(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Two halves of weighted points by Ward's criterion along the first principal axis."""
    mean = np.average(points, axis=0, weights=weight)
    centred = points - mean
    _, _, axes = np.linalg.svd(centred * np.sqrt(weight)[:, None], full_matrices=False)
    order = np.argsort(centred @ axes[0], kind="stable")
    w = np.cumsum(weight[order])[:-1]
    s = np.cumsum(points[order] * weight[order][:, None], axis=0)[:-1]
    rest = weight.sum() - w
    total = (points * weight[:, None]).sum(axis=0)
    gain = (s**2).sum(axis=1) / w + ((total - s) ** 2).sum(axis=1) / rest
    side = np.zeros(len(points), bool)
    side[order[: int(gain.argmax()) + 1]] = True
    return side


def categorical_groups(cells: DataFrame, levels: list[str], vector: str, least: int, hard: tuple[str, ...] = ()) -> DataFrame:
    """cells with `group`: categories of each level are joined into groups of at least `least` cells, level by level.

    Means and counts of the category combinations are made in Spark; the tree over those few centroids splits in
    two for as long as both sides have enough cells. A hard level splits fully, at any depth. Cells with a null
    category are left out.
    """
    rows = cells.dropna(subset=levels)
    centroids = mean_vectors(rows.withColumn("_k", F.struct(*levels)), "_k", vector).join(rows.groupBy(F.struct(*levels).alias("_k")).agg(F.count("*").alias("n")), "_k").select("_k.*", "mean", "n").toPandas()
    centroids = centroids.sort_values(levels, ignore_index=True)
    vectors, n = np.array(centroids["mean"].tolist(), float).reshape(len(centroids), -1), centroids["n"].to_numpy(float)

    def grow(at: np.ndarray, depth: int) -> list[np.ndarray]:
        if depth == len(levels):
            return [at]
        level = levels[depth]
        names = sorted(set(centroids[level].iloc[at]))
        parts = [at[(centroids[level].iloc[at] == x).to_numpy()] for x in names]
        if level not in hard:
            todo, done = [list(range(len(parts)))], []
            while todo:
                node = todo.pop()
                points = np.array([np.average(vectors[parts[k]], axis=0, weights=n[parts[k]]) for k in node])
                weight = np.array([n[parts[k]].sum() for k in node])
                side = _split(points, weight) if len(node) > 1 else np.array([True])
                if len(node) > 1 and weight[side].sum() >= least and weight[~side].sum() >= least:
                    todo += [[k for k, s in zip(node, side, strict=True) if s == want] for want in (True, False)]
                else:
                    done.append(node)
            parts = [np.concatenate([parts[k] for k in node]) for node in done]
        return [leaf for part in parts for leaf in grow(part, depth + 1)]

    leaves = sorted((sorted(x.tolist()) for x in grow(np.arange(len(centroids)), 0)), key=lambda x: x[0]) if len(centroids) else []
    label = {k: f"group{i}" for i, leaf in enumerate(leaves) for k in leaf}
    table = pd.DataFrame({**{c: centroids[c].astype(str) for c in levels}, "group": [label[k] for k in range(len(centroids))]})
    names = cells.sparkSession.createDataFrame(table, ", ".join(f"{c} string" for c in [*levels, "group"]))
    return rows.join(small(names, n=len(table)), levels)  # one row for each combination of categories


def apply_groups(cells: DataFrame, saved: DataFrame, levels: list[str]) -> DataFrame:
    """cells with the group of a saved grouping, whose columns hold lists of categories."""
    table = saved
    for c in levels:
        table = table.withColumn(c, F.explode(c))
    return cells.join(table.select(*levels, "group"), levels)


def metacells(cells: DataFrame, group: str, key: str, vector: str, size: int, seed: int = 0) -> DataFrame:
    """cells with `metacell`: near cells of a group together, fewer than 2 * size of them, by one rule at every size.

    Each part with 2 * size cells or more is cut at the median of the one of four seeded projections that spreads it
    most; cells at the median itself, copies above all, are dealt to both sides by a hash of the key. A cut is one
    aggregation over all cells, with a row for each part; no part is gathered anywhere. A side gets three quarters of
    its part at most, but for the error of approximate medians, so that the number of rounds grows with the logarithm
    of the largest group. Small groups stay whole; null groups are a group, null vectors stand at the origin.
    """
    x = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))

    def projected(turn: int) -> Column:
        """Four sums of the vector's entries with seeded signs."""

        def one(k: int) -> Column:
            signed = F.transform(x, lambda v, i: v * (F.pmod(F.xxhash64(i, F.lit(turn), F.lit(k), F.lit(seed)), F.lit(2)) * 2 - 1))
            return F.aggregate(signed, F.lit(0.0), lambda s, v: s + v)

        return F.array(*[one(k) for k in range(4)])

    parts = park(cells.select(group, key, vector, F.lit(1).cast("decimal(38,0)").alias("_part")))
    turn = 0
    while True:
        turn += 1
        rows = parts.withColumn("_p", projected(turn))
        spread = [F.struct(F.coalesce(F.stddev_pop(F.col("_p")[k]), F.lit(0.0)).alias("s"), F.lit(k).alias("k"), F.percentile_approx(F.col("_p")[k], 0.5, 1000).alias("m")) for k in range(4)]
        cuts = park(rows.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.array_max(F.array(*spread)).alias("_cut")).filter(F.col("_n") >= 2 * size))
        if cuts.isEmpty():
            break
        at = F.get("_p", F.col("_cut.k"))
        coin = F.pmod(F.xxhash64(F.col(key), F.lit(turn), F.lit(seed)), F.lit(2))
        side = F.when(at > F.col("_cut.m"), 1).when(at < F.col("_cut.m"), 0).otherwise(coin)
        cut = cuts.select(F.col(group).alias("_g"), F.col("_part").alias("_q"), "_cut")
        joined = rows.join(cut, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")), "left")
        moved = F.when(F.col("_cut").isNull(), F.col("_part")).otherwise((F.col("_part") * 2 + side).cast("decimal(38,0)"))
        parts = park(joined.select(group, key, vector, moved.alias("_part")))
    named = parts.select(F.col(key).alias("_key"), F.concat_ws("_", F.col(group).cast("string"), F.col("_part").cast("string")).alias("metacell"))
    return cells.join(named, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def bisect(cells: DataFrame, vector: str, most: int, seed: int = 0) -> DataFrame:
    """cells with `part`, from repeated halving of the largest parts until none should exceed 2 * most cells."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = cells.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    k = max(1, -(-rows.count() // most))
    if k == 1:
        return cells.withColumn("part", F.lit(0))
    model = BisectingKMeans(k=k, minDivisibleClusterSize=2.0 * most, seed=seed, featuresCol="_v", predictionCol="part").fit(rows)
    return model.transform(rows).drop("_v")
