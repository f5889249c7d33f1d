"""Motif models and scans: pwm(motif_id, pos, a, c, g, t), sequences (key, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locuslake.operators.checks import require_unique
from locuslake.operators.sampling import hash_order, uniform

PSEUDO = 0.8
#: Steps of the discretised score of one position.
STEPS = 1000

HIT = "motif_id string, strand string, start long, end long, score double"


def information(pwm: DataFrame) -> DataFrame:
    """(motif_id, pos, entropy, information) of each position, in bits."""
    part = lambda c: F.when(F.col(c) > 0, -F.col(c) * F.log2(F.col(c))).otherwise(0.0)
    e = part("a") + part("c") + part("g") + part("t")
    return pwm.select("motif_id", "pos", e.alias("entropy"), (2 - e).alias("information"))


def consensus(pwm: DataFrame) -> DataFrame:
    """(motif_id, consensus): the likeliest base of each position, the first on ties."""
    best = F.when((F.col("a") >= F.col("c")) & (F.col("a") >= F.col("g")) & (F.col("a") >= F.col("t")), "A").when((F.col("c") >= F.col("g")) & (F.col("c") >= F.col("t")), "C").when(F.col("g") >= F.col("t"), "G").otherwise("T")
    return pwm.groupBy("motif_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", best.alias("b")))), lambda x: x["b"]), "").alias("consensus"))


def trim(pwm: DataFrame, most: int) -> DataFrame:
    """pwm cut to the run of `most` positions with the most information in each motif, the leftmost on ties."""
    i = information(pwm)
    w = W.partitionBy("motif_id").orderBy("pos").rowsBetween(0, most - 1)
    runs = i.withColumn("sum", F.round(F.sum("information").over(w), 9)).withColumn("n", F.count("*").over(w))
    runs = runs.withColumn("_full", F.max("n").over(W.partitionBy("motif_id"))).filter("n = _full")
    start = runs.groupBy("motif_id").agg(F.min_by("pos", F.struct((-F.col("sum")).alias("s"), "pos")).alias("first"))
    return pwm.join(start, "motif_id").filter((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("first") + most)).withColumn("pos", F.col("pos") - F.col("first")).drop("first")


def trim_by_contribution(pattern: DataFrame, least_information: float, least_contribution: float) -> DataFrame:
    """Positions of a pattern (motif_id, pos, information, contribution) between the outermost ones over both limits."""
    keep = pattern.filter((F.col("information") >= least_information) & (F.abs("contribution") >= least_contribution)).groupBy("motif_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return pattern.join(keep, "motif_id").filter("pos between lo and hi").drop("lo", "hi")


def sample_sequences(pwm: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(motif_id, k, seq): n sequences drawn from each motif by hashes."""
    u = uniform(seed, F.col("motif_id"), F.col("k"), F.col("pos"))
    base = F.when(u < F.col("a"), "A").when(u < F.col("a") + F.col("c"), "C").when(u < F.col("a") + F.col("c") + F.col("g"), "G").otherwise("T")
    rows = pwm.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("motif_id", "k", F.struct("pos", base.alias("b")).alias("x"))
    return rows.groupBy("motif_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("seq"))


def log_odds(pfm: np.ndarray, background: tuple[float, float, float, float] = (0.25,) * 4, pseudo: float = PSEUDO) -> np.ndarray:
    """log2 odds (positions x ACGT) of a count or frequency matrix, with the pseudocount shared out by the background."""
    b = np.array(background)
    p = (pfm + pseudo * b) / (pfm.sum(axis=1, keepdims=True) + pseudo)
    return np.log2(p / b)


def threshold(matrix: np.ndarray, p_value: float, background: tuple[float, float, float, float] = (0.25,) * 4, steps: int = STEPS) -> float:
    """The least score s with P(score >= s) <= p_value under the background, from the distribution of rounded scores."""
    low = matrix.min(axis=1, keepdims=True)
    unit = max(float((matrix.max(axis=1) - matrix.min(axis=1)).max()) / steps, 1e-9)
    cells = np.rint((matrix - low) / unit).astype(int)
    mass = np.ones(1)
    for row in cells:
        grown = np.zeros(len(mass) + row.max())
        for shift, p in zip(row, background, strict=True):
            grown[shift : shift + len(mass)] += p * mass
        mass = grown
    tail = np.cumsum(mass[::-1])[::-1]
    at = int(np.argmax(tail <= p_value)) if (tail <= p_value).any() else len(tail)
    return float(at * unit + low.sum())


def log_odds_rows(pwm: DataFrame, background: tuple[float, float, float, float] = (0.25,) * 4, pseudo: float = PSEUDO) -> DataFrame:
    """(motif_id, pos, a, c, g, t): log_odds() of every position, as columns."""
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t") + pseudo
    return pwm.select("motif_id", "pos", *[F.log2((F.col(x) + pseudo * b) / total / b).alias(x) for x, b in zip("acgt", background, strict=True)])


#: Most partial words that best_words() keeps of a motif; where it would take more, scores are convolved.
WORDS = 256


def _few_words(length: int, p_value: float, background: tuple[float, ...]) -> bool:
    """Whether best_words() serves: it keeps at most WORDS words, and sums of probabilities are exact, as they are with
    powers of two, so that the order of adding them doesn't matter where they meet p_value."""
    exact = all(np.frexp(b)[0] == 0.5 for b in background)
    return exact and p_value < 1 and min(4.0**length, p_value / min(background) ** length + 1) <= WORDS


def best_words(matrices: np.ndarray, p_value: float, background: tuple[float, ...], steps: int = STEPS) -> np.ndarray:
    """threshold() of many motifs of one length (motifs x positions x ACGT): words by how much their rounded score falls
    short of the best one, up to the first at which more than p_value has come together. A partial word can be left out
    behind one at which the words before it, with their best ends alone, exceed p_value."""
    low = matrices.min(axis=2, keepdims=True)
    unit = np.maximum((matrices.max(axis=2) - low[..., 0]).max(axis=1) / steps, 1e-9)
    cells = np.rint((matrices - low) / unit[:, None, None]).astype(np.int64)
    short = cells.max(axis=2, keepdims=True) - cells
    ends = np.array(background)[cells.argmax(axis=2)]
    loss, mass = np.zeros((len(cells), 1), np.int64), np.ones((len(cells), 1))
    for k in range(cells.shape[1]):
        loss = (loss[:, :, None] + short[:, k, None, :]).reshape(len(cells), -1)
        mass = (mass[:, :, None] * np.array(background)).reshape(len(cells), -1)
        order = np.argsort(loss, axis=1, kind="stable")
        loss, mass = np.take_along_axis(loss, order, 1), np.take_along_axis(mass, order, 1)
        over = np.cumsum(mass, axis=1) * ends[:, k + 1 :].prod(axis=1)[:, None] > p_value
        first = np.where(over.any(axis=1), over.argmax(axis=1), loss.shape[1] - 1)
        loss, mass = loss[:, : first.max() + 1], mass[:, : first.max() + 1]
    at = cells.max(axis=2).sum(axis=1) - loss[np.arange(len(cells)), first] + 1
    return at * unit + low.sum(axis=(1, 2))


def thresholds(pwm: DataFrame, p_value: float = 1e-4, background: tuple[float, float, float, float] = (0.25,) * 4) -> DataFrame:
    """(motif_id, length, matrix, threshold): log-odds matrix (row by row) and threshold of each motif.

    A motif's positions are gathered into a row; motifs of one length are done together where a few words decide, others by
    a convolution of their own.
    """
    gathered = pwm.groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[F.col(b).cast("double").alias(b) for b in "acgt"]))).alias("x"))
    flat = gathered.select("motif_id", F.size("x").alias("length"), F.flatten(F.transform("x", lambda x: F.array(*[x[b] for b in "acgt"]))).alias("matrix"))

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in batch.groupby("length"):
                m = log_odds(np.concatenate(rows["matrix"].to_numpy()).reshape(-1, 4).astype(float), background).reshape(len(rows), -1, 4)
                if _few_words(length, p_value, background):
                    limits = best_words(m, p_value, background)
                else:
                    limits = [threshold(x, p_value, background) for x in m]
                yield pd.DataFrame({"motif_id": rows["motif_id"], "length": rows["length"], "matrix": list(m.reshape(len(rows), -1)), "threshold": limits})

    return flat.mapInPandas(model, f"motif_id {dict(pwm.dtypes)['motif_id']}, length int, matrix array<double>, threshold double")


def models(pwm: DataFrame, p_value: float = 1e-4, background: tuple[float, float, float, float] = (0.25,) * 4) -> dict[str, tuple[np.ndarray, float]]:
    """Log-odds matrix and threshold of each motif, as every task of a scan needs them: a motif library is a small table."""
    found = thresholds(pwm, p_value, background).orderBy("motif_id").collect()
    return {r["motif_id"]: (np.array(r["matrix"]).reshape(-1, 4), r["threshold"]) for r in found}


_CODE = np.full(256, 4, np.uint8)
for _k, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _k


def _scores(code: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Score of every window of base numbers; windows with an unknown base score minus infinity."""
    n = len(code) - len(matrix) + 1
    if n <= 0:
        return np.empty(0)
    padded = np.concatenate([matrix, np.full((len(matrix), 1), -np.inf)], axis=1)
    return sum(padded[k][code[k : k + n]] for k in range(len(matrix)))


def scan(seqs: DataFrame, motifs: dict[str, tuple[np.ndarray, float]], key: str = "name", seq: str = "seq") -> DataFrame:
    """(key, motif_id, strand, start, end, score): all windows of either strand that reach their motif's threshold."""
    kind = dict(seqs.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row, s in enumerate(batch[seq]):
                code = _CODE[np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)]
                for motif, (matrix, least) in motifs.items():
                    for strand, m in (("+", matrix), ("-", matrix[::-1, ::-1])):
                        score = _scores(code, m)
                        at = np.nonzero(score >= least - 1e-9)[0]
                        if len(at):
                            found.append((np.full(len(at), row), [motif] * len(at), [strand] * len(at), at, at + len(m), np.round(score[at], 4)))
            if found:
                row, *parts = ([x for part in column for x in part] if k in (1, 2) else np.concatenate(column) for k, column in enumerate(zip(*found, strict=True)))
                yield pd.DataFrame({key: batch[key].to_numpy()[row], **dict(zip(["motif_id", "strand", "start", "end", "score"], parts, strict=True))})

    return seqs.select(key, seq).mapInPandas(find, f"{key} {kind}, {HIT}")


def genome_scan(tiles: DataFrame, motifs: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """(chrom, motif_id, strand, start, end, score) over tiles with slop; a hit belongs to the tile that owns its start."""
    hits = scan(tiles.withColumn("_tile", F.concat_ws("|", "chrom", "tile_start")), motifs, "_tile")
    owner = tiles.select(F.concat_ws("|", "chrom", "tile_start").alias("_tile"), "chrom", "tile_start", "tile_end", "seq_start")
    lifted = hits.join(owner, "_tile").withColumn("start", F.col("start") + F.col("seq_start")).withColumn("end", F.col("end") + F.col("seq_start"))
    return lifted.filter("start >= tile_start and start < tile_end").select("chrom", "motif_id", "strand", "start", "end", "score")


def best_hits(hits: DataFrame, key: str = "name") -> DataFrame:
    """(key, motif_id, score, strand, start, end): the best hit of each motif in each region, the leftmost on ties."""
    order = F.struct((-F.col("score")).alias("s"), "start", "strand")
    return hits.groupBy(key, "motif_id").agg(F.min_by(F.struct("score", "strand", "start", "end"), order).alias("x")).select(key, "motif_id", "x.*")


def merge_hits(hits: DataFrame, key: str = "name") -> DataFrame:
    """Hits of a motif on a strand that overlap or touch as one, half-open, with their best score and number."""
    w = W.partitionBy(key, "motif_id", "strand").orderBy("start", "end")
    new = F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    runs = hits.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "motif_id", "strand", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.count("*").alias("n")).drop("_run")


def name_of(header: Column) -> Column:
    """The motif's id in a header like "MA0478.2<tab>FOSL2": what stands before the first tab or space."""
    return F.split_part(F.split_part(header, F.lit("\t"), F.lit(1)), F.lit(" "), F.lit(1))


def split_names(hits: DataFrame, names: str, keep: DataFrame | None = None, out: str = "motif") -> DataFrame:
    """One row per name of a comma-joined list, only the wanted ones."""
    rows = hits.withColumn(out, F.explode(F.split(names, r"\s*,\s*"))).filter(F.col(out) != "")
    return rows if keep is None else rows.join(keep.select(out).distinct(), out, "left_semi")


def masked_rounds(seqs: DataFrame, motifs: dict[str, tuple[np.ndarray, float]], least: float, rounds: int = 3, key: str = "name", seq: str = "seq") -> DataFrame:
    """Hits accepted over rounds: the best non-masked hit of each region scores at least `least`, is taken, and its
    bases are masked before the next round."""
    out, left = None, seqs.select(key, seq)
    for k in range(rounds):
        hits = scan(left, motifs, key, seq).filter(F.col("score") >= least)
        top = hits.groupBy(key).agg(F.min_by(F.struct("motif_id", "strand", "start", "end", "score"), F.struct((-F.col("score")).alias("s"), "start", "motif_id", "strand")).alias("x")).select(key, "x.*", F.lit(k).alias("round"))
        out = top if out is None else out.unionByName(top)
        cut = top.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
        left = left.join(cut, key, "left").withColumn(seq, F.when(F.col("_s").isNotNull(), F.overlay(F.col(seq), F.repeat(F.lit("N"), (F.col("_e") - F.col("_s")).cast("int")), (F.col("_s") + 1).cast("int"), (F.col("_e") - F.col("_s")).cast("int"))).otherwise(F.col(seq))).drop("_s", "_e")
    return out


def annotate_hits(hits: DataFrame, peaks: DataFrame, motifs: DataFrame, quality: DataFrame) -> DataFrame:
    """Hits with their peak's, motif's and quality columns, genome coordinates and scaled score; one per (chrom,
    start, motif, strand), the best."""
    j = hits.join(peaks, "peak_id").join(motifs, "motif_id").join(quality, "peak_id")
    j = j.withColumn("start", F.col("peak_start") + F.col("hit_start")).withColumn("end", F.col("start") + F.col("motif_length")).withColumn("scaled", F.col("coefficient") * F.col("global_scale"))
    w = W.partitionBy("chrom", "start", "motif_name", "strand").orderBy(F.desc("scaled"), "peak_id")
    return j.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def top_matches(matches: DataFrame, item: str, cutoff: float) -> DataFrame:
    """The best match (least p, then motif) of each item with p under the cutoff, a negative offset and one cluster on
    both sides, with -log10 p."""
    m = matches.filter((F.col("offset") < 0) & (F.col("p") < cutoff) & (F.col("item_cluster") == F.col("motif_cluster")))
    w = W.partitionBy(item).orderBy("p", "motif_id")
    return m.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").withColumn("score", -F.log10("p"))


def by_cluster_and_sign(items: DataFrame, clusters: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n items of each motif cluster and sign of contribution, by hash order."""
    j = items.join(clusters, "motif_id").withColumn("sign", F.signum("contribution").cast("int"))
    w = W.partitionBy("cluster", "sign").orderBy(hash_order(F.col("item"), seed), "item")
    return j.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def hit_correlation(hits: DataFrame, values: DataFrame, pwm: DataFrame) -> DataFrame:
    """(hit, r): correlation of a hit's contributions (hit, pos, a, c, g, t) with its motif over all positions and
    bases, positions that a hit lacks counting 0; the minus strand is read reverse complemented, and the sign of the
    hit's sum is taken off. hits: hit, motif_id, strand. Null where either side is the same everywhere."""
    size = pwm.groupBy("motif_id").agg(F.max("pos").alias("last"))
    h = hits.join(size, "motif_id").join(pwm, "motif_id")
    v = values.select("hit", F.col("pos").alias("vpos"), *[F.col(b).alias(f"v{b}") for b in "acgt"])
    at = F.when(F.col("strand") == "-", F.col("last") - F.col("pos")).otherwise(F.col("pos"))
    j = h.withColumn("vpos", at).join(v, ["hit", "vpos"], "left")
    pick = lambda plus, minus: F.coalesce(F.when(F.col("strand") == "-", F.col(f"v{minus}")).otherwise(F.col(f"v{plus}")), F.lit(0.0))
    cells = j.select("hit", F.explode(F.array(*[F.struct(F.col(p).alias("m"), pick(p, q).alias("x")) for p, q in zip("acgt", "tgca", strict=True)])).alias("c"))
    m, x = F.col("c.m"), F.col("c.x")
    sums = cells.groupBy("hit").agg(F.covar_pop(m, x).alias("mx"), F.var_pop(m).alias("mm"), F.var_pop(x).alias("xx"), F.sum(x).alias("sum"))
    even = (F.col("mm") < 1e-12) | (F.col("xx") < 1e-12)
    return sums.select("hit", F.when(~even, F.col("mx") / F.sqrt(F.col("mm") * F.col("xx")) * F.signum("sum")).alias("r"))


def seqlet_flanks(seqlets: DataFrame, parents: DataFrame, flank: int) -> DataFrame:
    """Seqlets as centre +- flank in genome coordinates; those that leave their parent window are dropped.
    seqlets: parent, start, end (relative); parents: parent, chrom, start, end, a parent that comes twice is an error."""
    p = require_unique(parents, ["parent"]).select("parent", "chrom", F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    s = seqlets.withColumn("_c", centre).join(p, "parent").withColumn("start", F.col("_ps") + F.col("_c") - flank).withColumn("end", F.col("_ps") + F.col("_c") + flank)
    return s.filter("start >= _ps and end <= _pe").drop("_c", "_ps", "_pe")


def bound_over(attributions: DataFrame, cutoff: float, scores: str = "scores") -> DataFrame:
    """Rows of an attribution table whose greatest binding score exceeds the cutoff; null scores and empty lists do not."""
    return attributions.filter(F.array_max(scores) > cutoff)
