"""Evaluation statistics on long signal tables (ytrue, ypred), and reference/alternative pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.operators.ordered import quantiles
from locuslake.sources.store import park

EPS = 1e-7


def pearson(x: Column, y: Column, eps: float = EPS) -> Column:
    """Aggregate: correlation from five running sums, with eps added to the denominator."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sx, sy, sxy, sxx, syy = F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x), F.sum(y * y)
    cov = sxy - sx * sy / n
    return cov / (F.sqrt(F.greatest(sxx - sx * sx / n, F.lit(0.0))) * F.sqrt(F.greatest(syy - sy * sy / n, F.lit(0.0))) + eps)


def r2(ytrue: Column, ypred: Column) -> Column:
    """Aggregate: 1 - residual over total sum of squares; null where the truth is constant."""
    n = F.count(ytrue)
    total = F.sum(ytrue * ytrue) - F.sum(ytrue) * F.sum(ytrue) / n
    return F.when(F.abs(total) > 1e-9, 1 - F.sum((ytrue - ypred) * (ytrue - ypred)) / total)


def score_groups(signal: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """(keys, n, corr, r2) of ytrue and ypred."""
    t, p = F.col("ytrue").cast("double"), F.col("ypred").cast("double")
    return signal.groupBy(*keys).agg(F.count("*").alias("n"), pearson(t, p, eps).alias("corr"), r2(t, p).alias("r2"))


def sparse_pearson(signal: DataFrame, keys: list[str], n: Column, eps: float = EPS) -> DataFrame:
    """Correlation over n bins of which only the non-zero ones are rows."""
    t, p = F.col("ytrue").cast("double"), F.col("ypred").cast("double")
    s = signal.groupBy(*keys).agg(F.sum(t).alias("st"), F.sum(p).alias("sp"), F.sum(t * p).alias("stp"), F.sum(t * t).alias("stt"), F.sum(p * p).alias("spp"))
    c = (F.col("stp") - F.col("st") * F.col("sp") / n) / (F.sqrt(F.col("stt") - F.col("st") * F.col("st") / n) * F.sqrt(F.col("spp") - F.col("sp") * F.col("sp") / n) + eps)
    return s.select(*keys, c.alias("corr"))


def multi_level_stats(signal: DataFrame, peak: str = "peak", sample: str = "pid", levels: int = 5) -> DataFrame:
    """(level, metric, mean, std, n): correlation and R2 along samples ('profile') and along peaks ('sample'), over
    peaks of at least each quantile class of their deviation across samples."""
    spread = park(signal.groupBy(peak).agg(F.stddev_samp("ytrue").alias("_std")), "spread")
    edges = quantiles(spread, [], "_std", [k / levels for k in range(1, levels)]).first()
    level = sum(((F.col("_std") > F.lit(e)).cast("int") for e in edges if e is not None), F.lit(0))
    rows = signal.join(spread.withColumn("_level", level).filter("_std is not null"), peak).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_level"))))
    out = None
    for name, key in (("profile", peak), ("sample", sample)):
        s = score_groups(rows, ["level", key])
        of = lambda m: F.struct(F.lit(f"{name}_{m}").alias("metric"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.count(m).alias("n"))  # noqa: B023, E731
        part = s.groupBy("level").agg(F.array(of("corr"), of("r2")).alias("_m")).select("level", F.inline("_m"))
        out = part if out is None else out.unionByName(part)
    return out


def losses(signal: DataFrame, keys: list[str], weight: float = 0.2) -> DataFrame:
    """(keys, poisson, multinomial, poisson_multinomial, bce, mse): loss-style means over the bins of a key.

    Missing truth is left out. poisson: p - t log p. multinomial: minus the log-likelihood of the shares.
    """
    t, p = F.col("ytrue").cast("double"), F.greatest(F.col("ypred").cast("double"), F.lit(EPS))
    rows = signal.filter(F.col("ytrue").isNotNull() & ~F.isnan(F.col("ytrue").cast("double")))
    rows = rows.withColumn("_share", p / F.sum(p).over(W.partitionBy(*keys)))
    logit = F.col("ypred").cast("double")
    bce = F.greatest(logit, F.lit(0.0)) - logit * F.least(t, F.lit(1.0)) + F.log1p(F.exp(-F.abs(logit)))
    out = rows.groupBy(*keys).agg(
        F.avg(p - t * F.log(p)).alias("poisson"), (-F.sum(t * F.log(F.col("_share"))) / F.count("*")).alias("multinomial"),
        F.avg(bce).alias("bce"), F.avg((t - logit) * (t - logit)).alias("mse"), F.sum(t).alias("_t"), F.sum(p).alias("_p"), F.count("*").alias("_n"),
    )
    total = (F.col("_p") - F.col("_t") * F.log("_p")) / F.col("_n")
    return out.withColumn("poisson_multinomial", F.col("multinomial") + weight * total).drop("_t", "_p", "_n")


def pair_alleles(scores: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, ref, alt, log_fc) from rows with allele 'ref' or 'alt'; keys that lack one are left out."""
    of = lambda a: F.max(F.when(F.col("allele") == a, F.col(value))).alias(a)
    p = scores.groupBy(*keys).agg(of("ref"), of("alt")).filter("ref is not null and alt is not null")
    return p.withColumn("log_fc", F.when(F.col("alt") > 0, F.log2(F.col("alt") / (F.col("ref") + F.lit(1e-6)))))


def condition_pairs(values: DataFrame, keys: list[str], pid: str = "pid", value: str = "value") -> DataFrame:
    """(keys, c0, c1, idx, v0, v1, delta) from ids c0|c1:cond-idx; a malformed id is an error."""
    pattern = r"^([^|]+)\|([^:]+):(.+)-(\d+)$"
    part = lambda k: F.regexp_extract(pid, pattern, k)
    cond = F.when(F.col(pid).rlike(pattern), part(3)).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), F.col(pid))).cast("string"))
    rows = values.select(*keys, part(1).alias("c0"), part(2).alias("c1"), cond.alias("cond"), part(4).try_cast("int").alias("idx"), F.col(value).alias("_v"))
    side = lambda c: F.max(F.when(F.col("cond") == F.col(c), F.col("_v")))
    out = rows.groupBy(*keys, "c0", "c1", "idx").agg(side("c0").alias("v0"), side("c1").alias("v1")).filter("v0 is not null and v1 is not null")
    return out.withColumn("delta", F.col("v1") - F.col("v0"))


def moving(rows: DataFrame, group: str, order: list, value: str, size: int = 100, quantile: float = 0.9) -> DataFrame:
    """rows with mean, std and a quantile of the last `size` values."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(-(size - 1), 0)
    return rows.withColumn("mean", F.avg(value).over(w)).withColumn("std", F.stddev_samp(value).over(w)).withColumn("quantile", F.percentile(value, F.lit(quantile)).over(w))


def insulation(matrix: DataFrame, loci: DataFrame, width: int, pseudo: float = 1.0) -> DataFrame:
    """(locus, score): the larger mean of the two blocks beside a locus over the mean of the block between them.

    matrix: i, j, v (long, symmetric entries as rows); each entry is joined to the loci near i by an equi-join.
    """
    near = loci.select("locus", F.explode(F.sequence(F.col("locus") - width, F.col("locus") + width - 1)).alias("i"))
    m = matrix.join(near, "i").filter((F.col("j") >= F.col("locus") - width) & (F.col("j") < F.col("locus") + width))
    left, right = (F.col("i") < F.col("locus")) & (F.col("j") < F.col("locus")), (F.col("i") >= F.col("locus")) & (F.col("j") >= F.col("locus"))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("v"))), F.lit(0.0)) + pseudo
    return m.groupBy("locus").agg((F.greatest(mean(left), mean(right)) / mean(~left & ~right)).alias("score"))


def gather(parts: list[DataFrame], key: list[str], order: list, names: DataFrame | None = None) -> DataFrame:
    """All batches together, ids mapped back to the original ones, one row per key (the first in order)."""
    from locuslake.operators.sampling import keep_first

    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if names is not None:
        rows = rows.join(names.select(F.col("internal").alias("pid"), "original"), "pid", "left").withColumn("pid", F.coalesce("original", "pid")).drop("original")
    return keep_first(rows, key, order)


def top_by_quantile(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """rows with all but the top share q of |value| in each key set to 0."""
    edges = quantiles(rows.select(key, F.abs(F.col(value)).alias("_abs")), [key], "_abs", [1 - q]).select(F.col(key).alias("_key"), "q0")
    joined = rows.join(edges, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(value, F.when(F.abs(F.col(value)) >= F.col("q0"), F.col(value)).otherwise(F.lit(0.0))).drop("_key", "q0")


def around(signal: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Bins within radius of each key's centre: signal (region, bin, ...), centres (region, centre)."""
    return signal.join(centres, "region").filter((F.col("bin") >= F.col("centre") - radius) & (F.col("bin") < F.col("centre") + radius)).withColumn("offset", F.col("bin") - F.col("centre"))
