"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams of a language by rank. A document's own most frequent n-grams
are compared with each profile: an n-gram costs the difference of its two ranks, or the profile's length
where the profile lacks it (the out-of-place distance). The language at the least distance is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.shared import unit_hash

#: n-grams in a profile, and of a document that are compared with it.
PROFILE_SIZE = 400
#: Documents of each language, in expectation, that its profile is learned from.
PROFILE_DOCS = 2000
UNKNOWN = "und"
_EDGE = 1
_letter = np.full(0x110000, 2, np.uint8)  # 0 no, 1 yes, 2 not looked up yet


def grams(text: str | None) -> np.ndarray:
    """Codes of the 1- to 3-grams of a text's lower-cased words, with a mark at both ends of each word."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _letter[points]
    if (kind == 2).any():
        for p in np.unique(points[kind == 2]).tolist():
            _letter[p] = chr(p).isalpha()
        kind = _letter[points]
    marked = np.concatenate([[_EDGE], np.where(kind == 1, points, _EDGE), [_EDGE]]).astype(np.int64)
    x = marked[np.concatenate([[True], (marked[1:] != _EDGE) | (marked[:-1] != _EDGE)])]
    if len(x) < 3:
        return np.empty(0, np.int64)
    two = x[:-1] << 21 | x[1:]
    three = (two[:-1] << 21 | x[2:])[x[1:-1] != _EDGE]
    return np.concatenate([x[x != _EDGE], two, three])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Ranks of every n-gram that some language's profile has; `size` where a language's lacks it."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and closeness (1 less the distance over its maximum); ('und', 0.0) without a letter or a profile."""
        own = ranked(grams(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[at] == own
        apart = np.abs(self.ranks[:, at[known]] - np.arange(len(own))[known]).sum(axis=1) + self.size * int((~known).sum())
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (self.size * len(own))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample_key: str = "doc_id", size: int = PROFILE_SIZE, docs_per_language: int = PROFILE_DOCS, seed: int = 9) -> Profiles:
    """Profiles of the languages of labelled documents, from about docs_per_language of each, chosen by a hash of the key.

    The profiles (at most `size` n-grams for each language) are all that reaches the driver. Rows without a
    language or a text teach nothing; no such rows give no languages.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), unit_hash(seed, F.col(sample_key).cast("string")).alias("at")).filter("lang is not null and text is not null")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                if len(all_codes := np.concatenate([grams(t) for t in group["text"]])):
                    codes, counts = np.unique(all_codes, return_counts=True)
                    yield pd.DataFrame({"lang": name, "code": codes, "n": counts.astype(np.int64)})

    if not held:
        return Profiles([], np.empty(0, np.int64), np.empty((0, 0), np.int64), size)
    share = F.create_map([F.lit(x) for k, n in held.items() for x in (k, min(1.0, docs_per_language / n))])
    counts = rows.filter(F.col("at") < share[F.col("lang")]).drop("at").mapInPandas(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    top = counts.withColumn("rank", order).filter(F.col("rank") <= size).select("lang", "code", "rank").toPandas()
    languages = sorted(set(top["lang"]))
    codes = np.unique(top["code"].to_numpy(np.int64))
    ranks = np.full((len(languages), len(codes)), size, np.int64)
    row = {name: k for k, name in enumerate(languages)}
    ranks[top["lang"].map(row).to_numpy(np.int64), np.searchsorted(codes, top["code"].to_numpy(np.int64))] = top["rank"].to_numpy(np.int64) - 1
    return Profiles(languages, codes, ranks, size)


def classifier(profiles: Profiles) -> Callable[[Column], Column]:
    """A function of a text column that gives struct(lang_pred, score). Null, empty and letterless texts are 'und', score 0."""

    @pandas_udf("lang_pred string, score double")
    def classify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.classify(t) for t in texts], columns=["lang_pred", "score"])

    return classify


def identify(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row. Null, empty and letterless texts are 'und' with score 0; languages at
    equal distance go by their names; repeated rows stay repeated, other columns are ignored, an empty table gives
    none. About 60 bytes for each letter of a text are held at once."""
    return docs.select(F.col(doc_id).alias("doc_id"), classifier(profiles)(F.col(text)).alias("p")).select("doc_id", "p.lang_pred", "p.score")
