"""Benchmark decontamination by BM25 retrieval of test items and an overlap check.

An item counts as leaked if enough of its question's and of its answer's word shingles occur around a passage.
The test items are the indexed side: postings of (item, BM25 contribution), each divided by the least score
that the item can have where it leaks, with the greatest contribution of every term to each block of items.
Every document is read in overlapping passages, each long enough to hold any item whole; a passage with its
surroundings is a query, and block-max WAND retrieves all items that reach their least score: blocks whose
greatest contributions add up to less are skipped, and in the others the lists are walked from pivot to pivot.
A run of passages scores no less than its parts, so that the document is held against the blocks as a whole
first, then by halves. Retrieval thus loses no item that the shingles would find.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.shared import park

K1, B = 1.2, 0.75
SHINGLE_WORDS = 5
MIN_OVERLAP = 0.8
MIN_PASSAGE = 64
#: Items in a block. Small blocks bound tightly: with 4, one passage in a hundred is walked on the test tables, with 32 most.
BLOCK_ITEMS = 4
#: Most items, and about the most characters, that one index holds; a larger benchmark is taken in blocks. An index goes
#: to every task.
MAX_ITEMS, MAX_CHARS = 20_000, 16 << 20
#: Items up to so many characters share indexes, and so do longer ones up to eight times as many, and so on: passages are
#: twice as long as the longest item of their index.
SHORT_CHARS = 4096

_TOKEN = re.compile(r"[^\W_]+")
_LAST = re.compile(r"(?s)^(.*[.!?\n])\s*(\S.*?)\s*$")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """An item's words up to its last sentence, and those of its last sentence; an item of one sentence is all question."""
    m = _LAST.match((text or "").strip().rstrip(".!?"))
    return (tokens(m[1]), tokens(m[2])) if m and tokens(m[1]) else (tokens(text), [])


def shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    """All runs of k words; a shorter list is one run."""
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def may_lack(wanted: set, overlap: float) -> int:
    """The most shingles that can be missing where a share of at least `overlap` occurs."""
    n = len(wanted)
    return next((m for m in range(n, -1, -1) if (n - m) / n >= overlap), 0) if n else 0


def most_lost(words: list[str], k: int, lack: int, weights: dict[str, float]) -> float:
    """The greatest weight of words that lose all their shingles where `lack` distinct ones are missing.

    A word's weight stands at its first place, whose shingles occur there for the first time as well: missing
    one of them costs one, missing a repeat costs nothing.
    """
    size = len(words) - k + 1
    if lack <= 0 or size <= 0:
        return 0.0
    at = np.zeros(len(words))
    for w, weight in weights.items():
        at[words.index(w)] = weight
    seen: set[tuple[str, ...]] = set()
    # best[c, r]: c missing so far, the last r places missing; before the first place all are
    best = np.full((lack + 1, k + 1), -np.inf)
    best[0, k] = 0.0
    for j in range(size):
        shingle = tuple(words[j : j + k])
        cost = 0 if shingle in seen else 1
        seen.add(shingle)
        after = np.full_like(best, -np.inf)
        after[:, 0] = best.max(axis=1)
        missing = best[: lack + 1 - cost]
        after[cost:, 1:k] = missing[:, : k - 1]
        after[cost:, k] = missing[:, k - 1 :].max(axis=1) + at[j]
        best = after
    tail = [at[len(words) - r :].sum() if r else 0.0 for r in range(k)]
    return float((best + np.array([*tail, tail[k - 1]])).max())


def least_share(parts: list[tuple[list[str], set]], weights: dict[str, float], overlap: float) -> float:
    """A lower bound of the weight of an item's words that occur where `overlap` of each part's shingles do.

    parts: words and shingles of the question and of the answer; weights: of the item's words, adding up to 1.
    """
    free: list[dict[str, float]] = [{} for _ in parts]
    lacks = [may_lack(wanted, overlap) for _, wanted in parts]
    holders = [Counter(w for s in wanted for w in set(s)) for _, wanted in parts]
    for w, weight in weights.items():
        places = [p for p in range(len(parts)) if w in holders[p]]
        if all(holders[p][w] <= lacks[p] for p in places):
            # lost from all parts or from none: it counts in the one where it has most shingles to lose
            free[max(places, key=lambda p: holders[p][w] - lacks[p])][w] = weight
    lost = sum(most_lost(words, SHINGLE_WORDS, lack, own) for (words, _), lack, own in zip(parts, lacks, free, strict=True))
    # one shingle of each part with any that must occur is there
    kept = max((min(sum(weights[w] for w in set(s)) for s in wanted) for (_, wanted), lack in zip(parts, lacks, strict=True) if lack < len(wanted)), default=0.0)
    return max(1 - lost, kept)


class Index:
    """Inverted index of test items with block maxima.

    statistics: number of items, their mean number of words and the items that hold each word, of the whole
    benchmark where the items are a block of it.
    """

    def __init__(self, items: list[tuple[int, str | None]], overlap: float = MIN_OVERLAP, statistics: tuple[int, float, dict[str, int]] | None = None):
        if not 0 < overlap <= 1:
            raise ValueError("overlap must lie in (0, 1]")
        self.overlap = overlap
        self.items, asked = [], []
        for item_id, text in items:
            if tokens(text):
                question, answer = question_and_answer(text)
                self.items.append((item_id, question + answer, shingles(question, SHINGLE_WORDS), shingles(answer, SHINGLE_WORDS)))
                asked.append(len(question))
        n = len(self.items)
        self.passage = max(MIN_PASSAGE, 2 * max((len(x[1]) for x in self.items), default=0))
        average = sum(len(x[1]) for x in self.items) / max(n, 1)
        frequency = Counter(t for x in self.items for t in set(x[1]))
        self.terms = {t: k for k, t in enumerate(sorted(frequency))}
        total = n
        if statistics:
            total, average, frequency = statistics
        raw: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.least, self.shares = [], []
        for k, (_, words, question, answer) in enumerate(self.items):
            parts = {
                t: math.log(1 + (total - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
                for t, tf in Counter(words).items()
            }
            own = sum(parts.values())
            shares = {t: part / own for t, part in parts.items()}
            self.least.append(least_share([(words[: asked[k]], question), (words[asked[k] :], answer)], shares, overlap))
            self.shares.append(shares)
            for t, share in shares.items():
                raw[self.terms[t]].append((k, share / self.least[k]))
        self.postings = {t: ([k for k, _ in x], [p for _, p in x]) for t, x in raw.items()}
        tops: dict[tuple[int, int], float] = {}
        for t, (ids, parts) in self.postings.items():
            for k, part in zip(ids, parts, strict=True):
                at = (t, k // BLOCK_ITEMS)
                tops[at] = max(tops.get(at, 0.0), part)
        keys = sorted(tops)
        self.blocks = -(-n // BLOCK_ITEMS)
        self.block = np.array([b for _, b in keys], np.int64)
        self.top = np.array([tops[x] for x in keys])
        self.start = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(self.terms) + 1))

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The most that an item of each block can score for distinct terms."""
        first = self.start[query]
        lengths = self.start[query + 1] - first
        at = np.arange(lengths.sum()) + np.repeat(first - np.cumsum(lengths) + lengths, lengths)
        return np.bincount(self.block[at], self.top[at], self.blocks)

    def retrieve(self, query: np.ndarray, least: float = 1.0) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least `least`, by block-max WAND; 1 is the least score of a leaked item."""
        found = []
        for b in np.nonzero(self.bounds(query) >= least - 1e-9)[0].tolist():
            lists = []
            for t in query.tolist():
                ids, parts = self.postings[t]
                lo, hi = bisect_left(ids, b * BLOCK_ITEMS), bisect_left(ids, (b + 1) * BLOCK_ITEMS)
                if lo < hi:
                    lists.append([ids[lo], max(parts[lo:hi]), lo, hi, ids, parts])
            while lists:
                lists.sort(key=lambda x: x[0])
                bound, pivot = 0.0, None
                for x in lists:
                    bound += x[1]
                    if bound >= least - 1e-9:
                        pivot = x[0]
                        break
                if pivot is None:
                    break
                if lists[0][0] == pivot:
                    score = sum(x[5][x[2]] for x in lists if x[0] == pivot)
                    if score >= least - 1e-9:
                        found.append((pivot, score))
                    to = pivot + 1
                else:
                    to = pivot
                for x in lists:
                    if x[0] < to:
                        x[2] = bisect_left(x[4], to, x[2], x[3])
                        x[0] = x[4][x[2]] if x[2] < x[3] else -1
                lists = [x for x in lists if x[0] >= 0]
        return found

    def leaks(self, text: str | None) -> dict[int, tuple[float, float, float]]:
        """item id -> (best score, question overlap, answer overlap) of every item that a whole text leaks."""
        words = tokens(text)
        if not words or not self.items:
            return {}
        out: dict[int, tuple[float, float, float]] = {}
        if not self._reached(np.fromiter((self.terms[w] for w in set(words) & self.terms.keys()), np.int64)):
            return out
        ids = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
        known = np.nonzero(ids >= 0)[0]
        ids = ids[known]
        step = self.passage // 2
        # runs of passages, halved for as long as they hold enough terms together
        stack = [(0, max(1, -(-(len(words) - step) // step)))]
        while stack:
            i, j = stack.pop()
            begin, end = np.searchsorted(known, ((i - 1) * step, j * step + self.passage))
            query = np.unique(ids[begin:end])
            if not self._reached(query):
                continue
            if j - i > 1:
                stack += [(i, (i + j) // 2), ((i + j) // 2, j)]
                continue
            near = words[max(0, (i - 1) * step) : i * step + self.passage + step]
            around: set | None = None
            for k, _ in self.retrieve(query):
                around = around or shingles(near, SHINGLE_WORDS)
                item_id, _, question, answer = self.items[k]
                asked, answered = (self._share(x, around, near) for x in (question, answer))
                if asked >= self.overlap and answered >= self.overlap:
                    there = set(words[i * step : i * step + self.passage])
                    score = sum(share for t, share in self.shares[k].items() if t in there)
                    out[item_id] = max(out.get(item_id, (0.0, 0.0, 0.0)), (score, asked, answered))
        return out

    def _reached(self, query: np.ndarray) -> bool:
        return bool(len(query)) and self.bounds(query).max() >= 1 - 1e-9

    @staticmethod
    def _share(wanted: set, around: set, near: list[str]) -> float:
        """Share of the shingles that occur; a part shorter than a shingle must occur as a run of words."""
        if not wanted:
            return 1.0
        k = len(next(iter(wanted)))
        there = around if k == SHINGLE_WORDS else shingles(near, k)
        return len(wanted & there) / len(wanted)


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", overlap: float = MIN_OVERLAP, max_items: int = MAX_ITEMS) -> Iterator[Index]:
    """The benchmark as one index, or as several of at most about max_items items of like length, scored alike."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null").distinct()
    rows = rows.withColumn("width", F.ceil(F.greatest(F.log(8.0, F.length("text") / SHORT_CHARS), F.lit(0.0))).cast("int"))
    # a row for each power of eight
    widths = rows.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy("width").collect()
    parts = [(r["width"], k, m) for r in widths for m in [max(-(-r["n"] // max_items), -(-r["chars"] // MAX_CHARS), 1)] for k in range(m)]
    if len(parts) <= 1:
        yield Index(sorted(tuple(r) for r in rows.select("item_id", "text").collect()), overlap)
        return

    @pandas_udf("array<string>")
    def item_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for part in question_and_answer(t) for w in part])

    rows = park(rows.select("item_id", "text", "width", item_words("text").alias("words")).filter("size(words) > 0"))
    total, average = rows.agg(F.count("*"), F.avg(F.size("words"))).first()
    held = lambda part: part.select(F.explode(F.array_distinct("words")).alias("term"))
    frequency = park(held(rows).groupBy("term").agg(F.count("*").alias("n")))
    for width, k, blocks in parts:
        part = rows.filter((F.col("width") == width) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k))
        counts = {r["term"]: r["n"] for r in frequency.join(held(part).distinct(), "term").collect()}
        yield Index(sorted(tuple(r) for r in part.select("item_id", "text").collect()), overlap, (total, average, counts))


LEAK = "item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: float = MIN_OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each row of docs and item it leaks.

    Null and empty texts leak nothing, null or wordless items are no items; repeated rows of docs repeat their
    leaks, and so do equal texts; other columns are ignored; without documents or items there are none. A text's
    words are held at once, about 80 bytes each.
    """
    found = None
    for index in indexes(items, item_id, item_text, overlap):

        def search(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, i, *x) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i, x in sorted(index.leaks(t).items())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        # ids travel as text: pandas would turn a column of numbers with a null among them into floats
        part = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(search, f"doc_id string, {LEAK}")
        found = part if found is None else found.union(part)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def leak_test(index: Index) -> Callable[[Column], Column]:
    """A function of a text column that says whether the text leaks an item of the index."""

    @pandas_udf("boolean")
    def leaked(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.leaks(t)) for t in texts], dtype=bool)

    return leaked


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", overlap: float = MIN_OVERLAP) -> DataFrame:
    """The rows of docs that leak no item, with all their columns.

    Null and empty texts and repeated rows stay, all rows do without items; an empty table gives none.
    """
    for index in indexes(items, item_id, item_text, overlap):
        docs = docs.filter(~leak_test(index)(F.col(text)))
    return docs
