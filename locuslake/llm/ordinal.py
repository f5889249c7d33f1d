"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s(text)) with one score s, linear in hashed text features and shared by
all grades, and thresholds in rising order. The model gives the expected grade and the probability of a grade
of at least the selected one, by which documents are chosen. With two grades it is logistic regression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.hashed import Adam, Sparse, bucket, sigmoid

BUCKETS = 1 << 16
#: Most rated documents that the model is fitted on.
MAX_RATED = 8000
STEPS, RATE, DECAY = 250, 0.05, 2e-4
CACHE = 500_000

_RUNS = re.compile(r"(?P<U>[^\W\d_a-z]*[A-Z][^\W\d_a-z]+)|(?P<a>[^\W\d_]+)|(?P<d>\d+)")


def shape(token: str) -> str:
    """A token with runs of letters and digits folded: 'a', 'U' for two or more capitals, 'd'."""
    return _RUNS.sub(lambda m: m.lastgroup, token)


def token_features(token: str) -> tuple[int, int]:
    return bucket(token.lower(), BUCKETS), bucket(f"\x00{shape(token)}", BUCKETS)


_SAME_WORD, _SAME_LINE, _FEW_WORDS = (bucket(f"\x01{x}", BUCKETS) for x in ("word like the last", "line seen before", "few words"))


def features(text: str | None, cache: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text: roots of the frequencies of its tokens and token shapes, and of
    words like the one before and lines seen before. Null and empty texts have the short-text feature alone."""
    tokens = text.split() if text else []
    counts: Counter[int] = Counter()
    if len(cache) > CACHE:
        cache.clear()
    for token, n in Counter(tokens).items():
        own = cache.get(token)
        if own is None:
            own = cache[token] = token_features(token)
        counts[own[0]] += n
        counts[own[1]] += n
    total = len(tokens)
    share = {f: n / total for f, n in counts.items()}
    lines = [x for x in text.split("\n") if x.strip()] if text else []
    for feature, value in (
        (_SAME_WORD, sum(map(str.__eq__, tokens, tokens[1:])) / max(total, 1)),
        (_SAME_LINE, 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0),
        (_FEW_WORDS, 1 / (1 + total)),
    ):
        if value:
            share[feature] = share.get(feature, 0.0) + value
    return np.fromiter(share, np.int64, len(share)), np.sqrt(np.fromiter(share.values(), float, len(share)))


@dataclass(frozen=True)
class CumulativeLink:
    grades: list[int]
    thresholds: np.ndarray
    weights: np.ndarray

    def rate(self, score: np.ndarray, select: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= select) for scores."""
        below = sigmoid(self.thresholds[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        mass = np.diff(edges, axis=1)
        of = np.array(self.grades, float)
        return mass @ of, mass[:, of >= select].sum(axis=1)


def edges_of(theta: np.ndarray) -> np.ndarray:
    """Thresholds in order from a first one and the logarithms of the gaps."""
    return np.cumsum(np.append(theta[:1], np.exp(theta[1:])))


def loss_and_gradient(x: Sparse, y: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grade numbers y, and its gradient in the weights and in theta."""
    k = len(theta)
    edges = np.concatenate([[-np.inf], edges_of(theta), [np.inf]])
    s = x.dot(weights)
    upper, lower = sigmoid(edges[y + 1] - s), sigmoid(edges[y] - s)
    mass = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper) / mass / len(y), lower * (1 - lower) / mass / len(y)
    d_edge = np.bincount(y, -d_upper, k + 1)[:k] + np.bincount(y, d_lower, k + 1)[1:]
    after = np.cumsum(d_edge[::-1])[::-1]
    return -float(np.log(mass).mean()), x.gradient(d_upper - d_lower, len(weights)), np.append(after[:1], after[1:] * np.exp(theta[1:]))


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: list[int]) -> CumulativeLink:
    """Maximum likelihood with weight decay. Thresholds are kept in order as a first one and positive gaps."""
    levels = sorted(set(grades))
    weights = np.zeros(BUCKETS)
    if len(levels) < 2:
        return CumulativeLink(levels or [0], np.empty(0), weights)
    x, y = Sparse(rows, values), np.searchsorted(levels, grades)
    k = len(levels) - 1
    share = np.cumsum(np.bincount(y, minlength=k + 1) / len(y))[:-1].clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    theta = np.append(start[:1], np.log(np.maximum(np.diff(start), 1e-3)))
    adam_w, adam_t = Adam(BUCKETS, RATE), Adam(k, RATE)
    for _ in range(STEPS):
        _, d_weights, d_theta = loss_and_gradient(x, y, weights, theta)
        weights = weights + adam_w.step(d_weights + DECAY * weights)
        theta = theta + adam_t.step(d_theta)
    return CumulativeLink(levels, edges_of(theta), weights)


def learn(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", max_rated: int = MAX_RATED) -> CumulativeLink:
    """Fits on up to max_rated rated documents, chosen by a hash of the id. Null ids and grades rate nothing; a
    document rated more than once counts with its least grade."""
    rated = ratings.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(grade).cast("int").alias("_grade"))
    # the sample is bounded by max_rated rows of a few bytes
    chosen = F.broadcast(rated.orderBy(F.xxhash64(F.lit(10), F.col("_id").cast("string")), "_id").limit(max_rated))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(chosen, "_id").select("_id", F.col("_grade").alias("grade"), "text")

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for batch in batches:
            found = [features(t, cache) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["_id"], "grade": batch["grade"], "ids": [i.astype(np.int32).tobytes() for i, _ in found], "values": [v.astype(np.float32).tobytes() for _, v in found]})

    rows = texts.mapInPandas(extracted, "id long, grade int, ids binary, values binary").toPandas().sort_values(["id", "grade", "ids"])
    return fit([np.frombuffer(b, np.int32) for b in rows["ids"]], [np.frombuffer(b, np.float32) for b in rows["values"]], rows["grade"].tolist())


def rater(model: CumulativeLink, select: int) -> Callable[[Column], Column]:
    """A function of a text column that gives struct(expected_grade, tail_probability)."""
    weights = model.weights.astype(np.float32)
    model = CumulativeLink(model.grades, model.thresholds, np.empty(0))

    @pandas_udf("expected_grade double, tail_probability double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for texts in batches:
            score = np.empty(len(texts))
            for k, t in enumerate(texts):
                ids, values = features(t, cache)
                score[k] = values @ weights[ids]
            expected, tail = model.rate(score, select)
            yield pd.DataFrame({"expected_grade": expected, "tail_probability": tail})

    return rate


def select(docs: DataFrame, model: CumulativeLink, grade: int, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every row; kept: P(grade >= `grade`) is at least `least`.

    Null and empty texts are rated by the short-text feature. Repeated rows stay repeated, equal texts are rated
    equally, other columns are ignored, an empty table gives none. A text's tokens are held at once, about 100 bytes
    each.
    """
    rated = docs.select(F.col(doc_id).alias("doc_id"), rater(model, grade)(F.col(text)).alias("p"))
    return rated.select("doc_id", "p.expected_grade", "p.tail_probability").withColumn("kept", F.col("tail_probability") >= least)
