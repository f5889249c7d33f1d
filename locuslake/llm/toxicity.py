"""Toxicity by non-negative positive-unlabelled learning.

Documents confirmed as toxic are the positives; every other text is unlabelled, toxic or not. With the class
prior p, the risk of a scorer g is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]),   l(z) = log(1 + exp(-z)),

where the second term estimates the risk on negatives and is kept from going below zero: where it does, the
step climbs that term instead. No text counts as a negative. The prior is estimated from the same two samples: no
set of texts can be less frequent among the unlabelled than p times its frequency among the positives, so that
the least ratio of both frequencies over telling features bounds p from above. Features say which words and word
beginnings occur in the text, whole texts throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.hashed import Adam, Sparse, bucket, sigmoid
from locuslake.llm.shared import park

BUCKETS = 1 << 24
PREFIXES = (4, 5, 6, 7)
#: Most positives and most unlabelled texts that the classifier is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
#: A feature takes part if its frequency in positives exceeds that in unlabelled texts by so many standard errors.
SCREEN_Z = 4.0
#: A feature tells about the prior if it occurs in this share of the positives at least.
TELLING = 0.05
#: The prior where no feature tells.
UNTOLD_PRIOR = 0.1
STEPS, RATE, DECAY = 400, 0.05, 1e-3
CACHE = 500_000

_TOKEN = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[int]:
    return [bucket(word, BUCKETS), *(bucket(f"^{word[:k]}", BUCKETS) for k in PREFIXES if len(word) >= k)]


def features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text; none for null or empty texts."""
    found: set[int] = set()
    for word in set(_TOKEN.findall(text.lower())) if text else ():
        found.update(word_features(word))
    return np.fromiter(found, np.int64, len(found))


@dataclass(frozen=True)
class Scorer:
    weights: dict[int, float]
    bias: float

    def scores(self) -> Callable[[str | None], float]:
        """A function from text to probability; it keeps a bounded cache of the words it has met."""
        cache: dict[str, tuple[int, ...]] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            hit: set[int] = set()
            for word in set(_TOKEN.findall(text.lower())) if text else ():
                own = cache.get(word)
                if own is None:
                    if len(cache) >= CACHE:
                        cache.clear()
                    own = cache[word] = tuple(f for f in word_features(word) if f in weights)
                hit.update(own)
            return float(sigmoid(np.array(self.bias + sum(weights[f] for f in sorted(hit)))))

        return score


def risk_and_gradient(pos: Sparse, unl: Sparse, weights: np.ndarray, bias: float, prior: float) -> tuple[float, float, np.ndarray]:
    """(risk of positives, risk of negatives, gradient): the gradient, of weights and then of the bias, is that of their
    sum, or that of minus the second where it is below zero."""
    g_pos, g_unl = pos.dot(weights) + bias, unl.dot(weights) + bias
    positive = prior * np.logaddexp(0, -g_pos).mean()
    negative = np.logaddexp(0, g_unl).mean() - prior * np.logaddexp(0, g_pos).mean()
    d_pos = -prior * sigmoid(-g_pos) / pos.n
    d_neg_pos, d_neg_unl = -prior * sigmoid(g_pos) / pos.n, sigmoid(g_unl) / unl.n
    if negative >= 0:
        d_pos, d_unl = d_pos + d_neg_pos, d_neg_unl
    else:
        d_pos, d_unl = -d_neg_pos, -d_neg_unl
    size = len(weights)
    return positive, negative, np.append(pos.gradient(d_pos, size) + unl.gradient(d_unl, size), d_pos.sum() + d_unl.sum())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float) -> Scorer:
    """Minimises the non-negative risk over rows of features, sorted ones of which are chosen.

    Without positives or unlabelled rows every text scores the prior.
    """
    prior = min(max(prior, 1e-6), 0.95)
    pick = lambda rows: Sparse([np.searchsorted(chosen, r[np.isin(r, chosen)]) for r in rows])
    pos, unl = pick(positive), pick(unlabelled)
    size = len(chosen)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return Scorer({}, bias)
    adam = Adam(size + 1, RATE)
    for _ in range(STEPS):
        gradient = risk_and_gradient(pos, unl, weights, bias, prior)[2]
        gradient[:-1] += DECAY * prior * weights / 10
        move = adam.step(gradient)
        weights, bias = weights + move[:-1], bias + float(move[-1])
    return Scorer({int(i): float(w) for i, w in zip(chosen, weights, strict=True) if abs(w) > 1e-3}, bias)


def screen(counts: DataFrame, n_pos: int, n_unl: int) -> tuple[np.ndarray, float]:
    """Sorted features whose frequency in positives exceeds that in unlabelled texts by SCREEN_Z standard errors, and the
    estimate of the prior: the least of the telling ones' ratios, each taken a standard error up. counts: feature, pos, unl.

    Only features of three positives at least are looked at, whose number the bounded sample bounds.
    """
    f_pos, f_unl = F.col("pos") / max(1, n_pos), F.col("unl") / max(1, n_unl)
    mean = (F.col("pos") + F.col("unl")) / max(1, n_pos + n_unl)
    z = (f_pos - f_unl) / F.sqrt(F.greatest(mean * (1 - mean), F.lit(1e-12)) * (1 / max(1, n_pos) + 1 / max(1, n_unl)))
    rows = counts.withColumn("z", z).filter((F.col("z") >= SCREEN_Z) & (F.col("pos") >= 3)).select("feature", "pos", "unl").toPandas()
    p, u = rows["pos"].to_numpy(float) / max(1, n_pos), rows["unl"].to_numpy(float) / max(1, n_unl)
    telling = p >= TELLING
    ratio = (u + np.sqrt(u * (1 - u) / max(1, n_unl)) + 1 / max(1, n_unl)) / np.maximum(p, 1e-12)
    return np.sort(rows["feature"].to_numpy(np.int64)), float(ratio[telling].min()) if telling.any() else UNTOLD_PRIOR


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Scorer:
    """Fits a scorer on confirmed positives and on unlabelled texts.

    Positives are the documents with a label `toxic` = 1, up to max_positive, chosen by a hash of the id; other
    labels are not used. The unlabelled texts are drawn in the same way from all documents of docs, up to
    max_unlabelled, so that they hold toxic ones at the class prior. Features are counted and screened in Spark; the
    driver gets the screened ones alone. Rows with a null id are not drawn, of rows with one id the least text is;
    null labels are no labels; without positives every text scores UNTOLD_PRIOR.
    """
    rated = labels.filter((F.col(toxic) == 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id")).distinct()
    by_hash = F.xxhash64(F.lit(2), F.col("_id").cast("string"))
    drawn = docs.select(F.col(doc_id).alias("_id")).filter("_id is not null").orderBy(by_hash, "_id").limit(max_unlabelled).distinct().select("_id", F.lit(False).alias("_positive"))
    chosen = rated.orderBy(by_hash, "_id").limit(max_positive).select("_id", F.lit(True).alias("_positive")).union(drawn)
    # the sample is bounded by max_positive + max_unlabelled rows of a few bytes
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    texts = park(texts.groupBy("_id", F.col("_positive").alias("positive")).agg(F.min("text").alias("text")).drop("_id"))
    n_pos, n_unl = (texts.filter(F.col("positive") == kind).count() for kind in (True, False))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                kinds = [np.concatenate([*(features(t) for t in part["text"][part["positive"] == kind]), np.empty(0, np.int64)]) for kind in (True, False)]
                found, at = np.unique(np.concatenate(kinds), return_inverse=True)
                yield pd.DataFrame({"feature": found, "pos": np.bincount(at[: len(kinds[0])], minlength=len(found)), "unl": np.bincount(at[len(kinds[0]) :], minlength=len(found))})

    counts = texts.mapInPandas(counted, "feature long, pos long, unl long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    screened, prior = screen(counts, n_pos, n_unl)

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "ids": [np.intersect1d(features(t), screened, assume_unique=True).astype(np.int32).tobytes() for t in batch["text"]]})

    rows = texts.mapInPandas(extracted, "positive boolean, ids binary").toPandas()
    parts = [[np.frombuffer(b, np.int32).astype(np.int64) for b in sorted(rows["ids"][rows["positive"] == kind])] for kind in (True, False)]
    return fit(*parts, screened, prior)


def scorer(model: Scorer) -> Callable[[Column], Column]:
    """A function of a text column that gives the probability of being toxic; null and empty texts get the bias alone."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scores()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype=float)

    return score


def score_documents(docs: DataFrame, model: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row. Null and empty texts have no features and score by the bias alone;
    repeated rows stay repeated, equal texts score equally, other columns are ignored, an empty table gives none. A
    text's distinct words are held at once."""
    scored = docs.select(F.col(doc_id).alias("doc_id"), scorer(model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
