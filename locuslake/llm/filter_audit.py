"""Filter interaction audit by wide packed counters.

Five filters A to E can be applied in 120 orders, which gives 600 steps. What becomes of a document at each of them
depends on its mask alone, the set of filters that it fails (and on its labels, for what is lost). Every mask is mapped
to one big integer with a field of WIDTH bits for each step and counter; the sum of the integers of a part's documents
holds the whole audit of that part. A field counts documents of one part, fewer than 2**63, so that no field carries
into the next one. Spark adds up equal masks of a part first: n equal integers are one integer times n.

Whether a text is identical to one of a smaller id is found over the whole table, by SHA-256 of the text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuslake.llm.shared import GAP, word_count

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
WIDTH = 64
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


@lru_cache(maxsize=None)
def outcomes(mask: int, good: bool, toxic: bool) -> int:
    """The big integer of one document: bit k of mask is set if it fails the k-th filter."""
    packed, at = 0, 0
    for order in ORDERS:
        gone = False
        for letter in order:
            own = 1 << FILTERS.index(letter)
            fails = bool(mask & own)
            removed = fails and not gone
            for field in (not gone and not fails, removed, fails and gone, mask == own, removed and good, removed and toxic):
                packed |= int(field) << at
                at += WIDTH
            gone = gone or fails
    return packed


def unpack(total: int) -> np.ndarray:
    """The counters of all steps: an array of 600 rows, one column for each counter."""
    size = len(ORDERS) * len(FILTERS) * len(COUNTERS)
    return np.frombuffer(total.to_bytes(size * WIDTH // 8, "little"), "<u8").reshape(-1, len(COUNTERS)).astype(np.int64)


def report(part: str, masks: Iterable[tuple[int, bool, bool, int]]) -> pd.DataFrame:
    """The 600 rows of a part from its (mask, good, toxic, number of documents)."""
    steps = unpack(sum(n * outcomes(mask, good, toxic) for mask, good, toxic, n in masks))
    letters = [letter for order in ORDERS for letter in order]
    frame = pd.DataFrame(steps, columns=COUNTERS)
    frame.insert(0, "part", part)
    frame.insert(1, "filter_order", np.repeat(ORDERS, len(FILTERS)))
    frame.insert(2, "step", np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
    return frame.assign(shapley=frame["removed"].groupby(letters).transform("sum"))


def own_failures(text: Column) -> Column:
    """The mask of the filters A to D, which look at one text alone."""
    n, distinct = word_count(text), F.size(F.array_except(F.split(text, GAP), F.array(F.lit(""))))
    fails = [
        n < 50,
        100 * distinct < 65 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by what they fail.

    Rows of one text are counted by part and label before they meet those of other parts, so that a text with many
    copies is a row for each part and pair of labels. A null id is not smaller than any id, nor is any smaller than it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"), own_failures(body).alias("fails"),
    )
    told = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(told, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    same = ["digest", "part", "fails", "good", "toxic"]
    by_id = rows.groupBy(*same, "id").agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    counted = by_id.groupBy(*same).agg(F.sum("n").alias("n"), least, F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    first = counted.groupBy("digest").agg(F.min("least.id").alias("first"))
    holds_first = F.coalesce(F.col("least.id") == F.col("first"), F.lit(False))
    originals = F.col("n_null") + F.when(holds_first, F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("fails").alias("mask"), originals.alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - originals).alias("n")))
    split = counted.join(first, "digest").select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each part, order and step: what the step's filter keeps and removes, what it would have removed had the
    earlier ones not, what it alone would remove, what it loses, and its Shapley sum.

    A part is a source; a null source and an empty one are the part ''. Null texts count as empty. Repeated rows all
    count, and equal ids make no text a copy. An id labelled more than once has the highest of its labels. Further
    columns are ignored. An empty table gives none.
    """

    def part_report(found: pd.DataFrame) -> pd.DataFrame:
        # 32 masks and 4 pairs of labels: 128 rows at most
        return report(found["part"].iloc[0], zip(found["mask"].tolist(), found["good"].tolist(), found["toxic"].tolist(), found["n"].tolist()))

    return masks(docs, labels, doc_id, text, source).groupBy("part").applyInPandas(part_report, RESULT)


def sql() -> str:
    """The audit by counting masks against each step, for the tables documents and labels."""
    return r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
told AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  concat(CASE WHEN len(ws) < 50 THEN 'A' END, CASE WHEN 100 * list_unique(ws) < 65 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
    CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails
  FROM d LEFT JOIN told USING (doc_id)),
m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT part, good, toxic, n, fails, filter_order, step, own, contains(fails, own) AS hit,
  regexp_matches(fails, concat('[', before, '_]')) AS gone FROM m, s),
z AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
  CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM y GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z"""
