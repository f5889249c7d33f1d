"""Hard negatives from a Hilbert-ordered index with zone maps.

Vectors are put in the order of a Hilbert curve through their main directions, label by label, and written to Parquet
in blocks of BLOCK rows; SHELF blocks of one label make a shelf. Blocks and shelves carry zone maps, the least and the
greatest component in each dimension. For an anchor a and a zone [lo, hi], interval arithmetic bounds every inner product in
the zone:

    sum(min(a*lo, a*hi)) <= a.x <= sum(max(a*lo, a*hi)).

A search has windows [lower, upper] of scores for each anchor and looks for the k best rows in each: a shelf is read for
a group of anchors if its bounds meet a window of one of them, and inside of it a block only for the anchors whose
windows its own bounds meet. The most promising shelf is read first: the k best rows in it raise the lower ends before the
other shelves are chosen. Positives are a search without bounds among rows of the label, negatives one in the windows that the
positives' scores give, among rows of other labels. Nothing is approximate: what is not read cannot be in a result.

Work is dealt by tiles of a shelf and a band of anchors, both of bounded size, so that neither a hot label nor copies
of one vector make a long task. Scores are whole numbers, exact in float64 or int64 (checked).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.shared import park, partitions

#: Rows of a block, blocks of a shelf, anchors of a group, groups of a band, and shelves whose zones are looked at together.
BLOCK, SHELF, GROUP, BAND, PAGE = 256, 64, 256, 64, 1024
#: The curve is laid through AXES directions of BITS bits each, fitted on SAMPLE rows at most; all rows are indexed.
AXES, BITS, SAMPLE = 8, 7, 4096
#: Shelves of an anchor group that are read before the others are chosen.
PROBES = 1
NEVER, NO_ID = np.iinfo(np.int64).max, np.iinfo(np.int64).max

GROUPS = "grp long, label long, uids binary, ids binary, vectors binary, lower binary, upper binary"
BLOCKS = "shelf long, label long, uids binary, ids binary, vectors binary, lo binary, hi binary"
FOUND = "grp long, anchor int, win int, anchor_id long, score long, id long, uid long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points, one per row, of `bits` bits in each dimension; 63 bits in all at most."""
    x = cells.astype(np.int64).T.copy()
    # from the coarsest bit down: undo the turn (a swap with the first axis) or the mirroring that a cell gives those inside it
    for bit in range(bits - 1, 0, -1):
        finer = (1 << bit) - 1
        for axis in range(len(x)):
            mirrored = (x[axis] >> bit & 1).astype(bool)
            swap = np.where(mirrored, 0, (x[0] ^ x[axis]) & finer)
            x[0] ^= np.where(mirrored, finer, swap)
            x[axis] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | axis >> bit & 1
    return key


@dataclass(frozen=True)
class Curve:
    """A Hilbert curve through the main directions of a sample."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray) -> Curve:
        centred = sample - sample.mean(0)
        directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :AXES]
        along = sample @ directions
        return cls(directions, np.quantile(along, 0.01, axis=0), np.quantile(along, 0.99, axis=0))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        share = (vectors @ self.directions - self.low) / np.maximum(self.high - self.low, 1e-9)
        return hilbert(np.clip((share * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


@dataclass(frozen=True)
class Shape:
    """Number of dimensions, and whether sums of products are exact in float64 (else in int64)."""

    dims: int
    fits: bool

    def read(self, vectors: bytes) -> np.ndarray:
        return np.frombuffer(vectors, np.int32).reshape(-1, self.dims).astype(np.float64 if self.fits else np.int64)

    def padded(self, rows: pd.Series) -> np.ndarray:
        out = np.zeros((len(rows), self.dims), np.int32)
        for k, row in enumerate(rows):
            out[k, : len(row)] = row
        return out


def longs(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int64)


def quantised(rows: DataFrame, vec_id: str, embedding: str, label: str, relabel: Column) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: no null label, no null vector, all components finite."""
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.filter(F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite)
    return good.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), relabel.alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * 256)).alias("q"))


def packed(rows: DataFrame, parts: int, shape: Shape, size: int, schema: str, row_of) -> DataFrame:
    """Runs of `size` rows (label, key, uid, vec_id, q) that follow each other on the curve and share a label; row_of makes
    each of them a row, given a function that numbers what the task has made."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held = TaskContext.get().partitionId() << 32, pd.DataFrame()
        last, run = None, 0

        def emit(frame: pd.DataFrame) -> dict:
            nonlocal last, run, number
            label = int(frame["label"].iloc[0])
            run = 0 if label != last else run + 1
            number += 1 if last is None or row_of.starts(label != last, run) else 0
            last = label
            frame = frame.sort_values(["vec_id", "uid"])
            return row_of(number, label, frame["uid"].to_numpy(np.int64), frame["vec_id"].to_numpy(np.int64), shape.padded(frame["q"]))

        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            out = []
            edges = np.flatnonzero(np.diff(held["label"].to_numpy())) + 1
            for a, b in zip([0, *edges], [*edges, len(held)]):
                while b - a >= size or (b < len(held) and b > a):
                    out.append(emit(held.iloc[a : min(b, a + size)]))
                    a = min(b, a + size)
            held = held.iloc[a:]
            if out:
                yield pd.DataFrame(out)
        if len(held):
            yield pd.DataFrame([emit(held)])

    sorted_rows = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID))).repartitionByRange(parts, "label", "key", "uid").sortWithinPartitions("label", "key", "uid")
    return sorted_rows.select("label", "key", "uid", "vec_id", "q").mapInPandas(cut, schema)


class BlockRow:
    """A block with its zone map; every SHELF blocks of a label begin a shelf."""

    @staticmethod
    def starts(new_label: bool, run: int) -> bool:
        return new_label or run % SHELF == 0

    def __call__(self, number: int, label: int, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> dict:
        zone = {"lo": vectors.min(0).tobytes(), "hi": vectors.max(0).tobytes()}
        return {"shelf": number, "label": label, "uids": uids.tobytes(), "ids": ids.tobytes(), "vectors": vectors.tobytes()} | zone


class GroupRow:
    """A group of anchors, each with one window of all scores."""

    @staticmethod
    def starts(new_label: bool, run: int) -> bool:
        return True

    def __call__(self, number: int, label: int, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> dict:
        ends = {"lower": np.full(len(ids), -NEVER).tobytes(), "upper": np.full(len(ids), NEVER).tobytes()}
        return {"grp": number, "label": label, "uids": uids.tobytes(), "ids": ids.tobytes(), "vectors": vectors.tobytes()} | ends


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have with a vector of each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


def meets(least: np.ndarray, most: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """(anchor, window, zone): whether the zone's bounds meet the window."""
    return (most[:, None, :] >= lower[:, :, None]) & (least[:, None, :] <= upper[:, :, None])


def paged(blocks: DataFrame, shape: Shape) -> tuple[DataFrame, int]:
    """The shelves' zone maps, PAGE or so to a row, and the number of pages."""

    def widest(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = (np.stack([np.frombuffer(x, np.int32) for x in frame[c]]) for c in ("lo", "hi"))
        return pd.DataFrame({"shelf": [frame["shelf"].iloc[0]], "label": [frame["label"].iloc[0]], "lo": [lo.min(0).tobytes()], "hi": [hi.max(0).tobytes()]})

    shelves = park(blocks.select("shelf", "label", "lo", "hi").groupBy("shelf").applyInPandas(widest, "shelf long, label long, lo binary, hi binary"))
    pages = -(-shelves.count() // PAGE)

    def page(frame: pd.DataFrame) -> pd.DataFrame:
        one = {"page": frame["page"].iloc[0], "shelves": frame["shelf"].to_numpy(np.int64).tobytes(), "labels": frame["label"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([one | {"lo": b"".join(frame["lo"]), "hi": b"".join(frame["hi"])}])

    numbered = shelves.withColumn("page", F.pmod(F.xxhash64("shelf"), F.lit(max(1, pages))))
    return park(numbered.groupBy("page").applyInPandas(page, "page long, shelves binary, labels binary, lo binary, hi binary")), pages


def chosen(groups: DataFrame, pages: DataFrame, n_pages: int, shape: Shape, same: bool) -> DataFrame:
    """(grp, shelf, promise): the shelves that can hold a row of a window of the group, of the same label or of others.
    The promise is the sum of the anchors' scores with the middle of the zone."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                anchors, lo, hi = shape.read(row.vectors), shape.read(row.lo), shape.read(row.hi)
                lower, upper = (longs(x).reshape(len(anchors), -1) for x in (row.lower, row.upper))
                # bounds grow with the zone, a label at a time
                zones = np.flatnonzero((longs(row.labels) == row.label) == same)
                need = meets(*bounds(anchors, lo[zones], hi[zones]), lower, upper).any((0, 1))
                promise = (lo[zones] + hi[zones]).astype(float) @ anchors.sum(0)
                yield pd.DataFrame({"grp": row.grp, "shelf": longs(row.shelves)[zones][need], "promise": promise[need]})

    spread = groups.select("grp", "label", "vectors", "lower", "upper", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n_pages) - 1).cast("long"))).alias("page"))
    return spread.join(pages, "page").mapInPandas(pick, "grp long, shelf long, promise double")


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest of each row and their columns, the first of equal ones first; the columns are in the order of ids."""
    scores, rows = scores.copy(), np.arange(len(scores))
    value, at = np.empty((len(scores), k), scores.dtype), np.empty((len(scores), k), np.int64)
    nothing = scores.dtype.type(-NEVER)
    for t in range(k):
        at[:, t] = scores.argmax(1)
        value[:, t] = scores[rows, at[:, t]]
        scores[rows, at[:, t]] = nothing
    return value, at


def search_tile(blocks: list[tuple], group, shape: Shape, k: int) -> list[tuple]:
    """The k best rows of a shelf's blocks (uids, ids, vectors, lo, hi) in each window of the group's anchors.

    Scores found so far raise the lower ends; a row of an equal score may still have a smaller id, so that ends belong
    to the windows.
    """
    anchors, anchor_uids, anchor_ids = shape.read(group.vectors), longs(group.uids), longs(group.ids)
    lower, upper = (longs(x).reshape(len(anchors), -1).astype(anchors.dtype) for x in (group.lower, group.upper))
    size = (*lower.shape, k)
    scores, ids, uids = np.full(size, -NEVER, anchors.dtype), np.full(size, NO_ID), np.full(size, NO_ID)
    zones = bounds(anchors, np.concatenate([b[3] for b in blocks]), np.concatenate([b[4] for b in blocks]))
    for j, (own_uids, own_ids, vectors, _, _) in enumerate(blocks):
        least, most = zones[0][:, j], zones[1][:, j]
        floor = np.maximum(lower, scores[:, :, -1])
        reads = (most[:, None] >= floor) & (least[:, None] <= upper)
        readers = np.flatnonzero(reads.any(1))
        if not len(readers):
            continue
        products = anchors[readers] @ vectors.T
        products[own_uids[None, :] == anchor_uids[readers][:, None]] = -NEVER
        for w in range(lower.shape[1]):
            inside = (products >= floor[readers, w][:, None]) & (products <= upper[readers, w][:, None]) & (products > -NEVER)
            hit = np.flatnonzero(inside.any(1))
            if not len(hit):
                continue
            value, at = best(np.where(inside[hit], products[hit], anchors.dtype.type(-NEVER)), min(k, len(own_ids)))
            none = value == anchors.dtype.type(-NEVER)
            rows = readers[hit]
            value = np.concatenate([scores[rows, w], value], 1)
            new_ids = np.concatenate([ids[rows, w], np.where(none, NO_ID, own_ids[at])], 1)
            new_uids = np.concatenate([uids[rows, w], np.where(none, NO_ID, own_uids[at])], 1)
            order = np.lexsort((new_uids, new_ids, -value), axis=1)[:, :k]
            scores[rows, w], ids[rows, w], uids[rows, w] = (np.take_along_axis(x, order, 1) for x in (value, new_ids, new_uids))
    a, w, t = np.nonzero(uids != NO_ID)
    return [(group.grp, *x) for x in zip(a.tolist(), w.tolist(), anchor_ids[a].tolist(), scores[a, w, t].astype(np.int64).tolist(), ids[a, w, t].tolist(), uids[a, w, t].tolist())]


def found_in(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, bands: int, shape: Shape, k: int) -> DataFrame:
    """The k best rows in each window of each group in the shelves it is paired with, tile by tile."""

    def tile(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shelf = [(longs(b.uids), longs(b.ids), shape.read(b.vectors), shape.read(b.lo), shape.read(b.hi)) for b in left.itertuples(index=False)]
        rows = [x for group in right.itertuples(index=False) for x in search_tile(shelf, group, shape, k)] if shelf else []
        return pd.DataFrame(rows, columns=["grp", "anchor", "win", "anchor_id", "score", "id", "uid"])

    tiles = pairs.select("grp", "shelf", F.pmod(F.xxhash64("grp"), F.lit(bands)).alias("band"))
    own = tiles.select(F.col("shelf").alias("own_shelf"), F.col("band").alias("own_band")).distinct()
    left = own.join(blocks.drop("label"), F.col("own_shelf") == F.col("shelf")).drop("shelf").groupBy("own_shelf", "own_band")
    right = tiles.join(groups.drop("label"), "grp").groupBy("shelf", "band")
    return left.cogroup(right).applyInPandas(tile, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each window, with rank."""
    order = W.partitionBy("grp", "anchor", "win").orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_windows(groups: DataFrame, found: DataFrame, ends) -> DataFrame:
    """groups with the windows that `ends` makes of (lower, upper) and what was found; at most k rows a window."""

    def change(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.copy()
        for i in left.index:
            n = len(longs(left.at[i, "ids"]))
            lower, upper = ends(longs(left.at[i, "lower"]).reshape(n, -1), longs(left.at[i, "upper"]).reshape(n, -1), right)
            out.at[i, "lower"], out.at[i, "upper"] = lower.astype(np.int64).tobytes(), upper.astype(np.int64).tobytes()
        return out

    return groups.groupBy("grp").cogroup(found.groupBy("grp")).applyInPandas(change, GROUPS)


def search(groups: DataFrame, blocks: DataFrame, pages: DataFrame, n_pages: int, bands: int, shape: Shape, k: int, same: bool) -> DataFrame:
    """The k best rows in each window of the groups' anchors, among rows of the same label or of all others."""

    def raised(lower: np.ndarray, upper: np.ndarray, found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lower, full = lower.copy(), found[found["rank"] == k]
        at = full["anchor"].to_numpy(np.int64), full["win"].to_numpy(np.int64)
        lower[at] = np.maximum(lower[at], full["score"].to_numpy(np.int64))
        return lower, upper

    promising = W.partitionBy("grp").orderBy(F.desc("promise"), "shelf")
    pairs = chosen(groups, pages, n_pages, shape, same)
    probes = park(pairs.withColumn("rank", F.row_number().over(promising)).filter(F.col("rank") <= PROBES).select("grp", "shelf"))
    early = park(first(found_in(probes, groups, blocks, bands, shape, k), k))
    narrowed = park(with_windows(groups, early, raised))
    rest = chosen(narrowed, pages, n_pages, shape, same).join(probes, ["grp", "shelf"], "left_anti")
    late = found_in(rest, narrowed, blocks, bands, shape, k)
    return park(first(early.drop("rank").unionByName(late), k))


def mine(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", every: int = 50, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, relabel: Column | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id is divisible by
    `every` and each of its `positives` best other rows of the label, the `negatives` best rows of other labels whose score is
    from low to high per cent of the positive's. Equal scores are ordered by id.

    A score is the inner product of the components floor(256 * x); shorter vectors count as filled up with zeros.
    Rows with a null label, a null vector or a component that is null or not finite take no part. A null id is no
    anchor and comes after all ids. Of repeated rows each is a row and, by its id, an anchor of its own. relabel gives the
    label to use (by default the label itself); further columns are ignored. An empty table gives none. Components so
    large that a hundred times a score may leave 64 bits are an error.
    """
    spark = rows.sparkSession
    q = quantised(rows, vec_id, embedding, label, (F.col(f"`{label}`") if relabel is None else relabel).cast("long"))
    size = q.agg(F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda c: F.abs(c.cast("double"))))).alias("largest"), F.count("*").alias("n")).first()
    dims, most = max(1, size["dims"] or 0), (size["largest"] or 0.0)
    if most >= 2**31 - 1 or 100 * dims * most * most >= 2**63:
        raise ValueError(f"components of up to {most:.3g} in {dims} dimensions give scores beyond 64 bits")
    shape = Shape(dims, dims * most * most < 2**53)
    q = park(q.select("vec_id", "label", F.col("q").cast("array<int>").alias("q"), F.monotonically_increasing_id().alias("uid")))
    sample = [r["q"] for r in q.orderBy(F.xxhash64("vec_id", "q"), "uid").limit(SAMPLE).select("q").collect()]
    curve = Curve.fitted(shape.padded(pd.Series(sample)).astype(float) if sample else np.zeros((1, dims)))

    @pandas_udf("long")
    def place(vectors: pd.Series) -> pd.Series:
        return pd.Series(curve.places(shape.padded(vectors).astype(float)))

    keyed = park(q.withColumn("key", place("q")))
    blocks = park(packed(keyed, partitions(spark), shape, BLOCK, BLOCKS, BlockRow()))
    own = keyed.filter(F.col("vec_id") % every == 0)
    n_groups = -(-own.count() // GROUP)
    groups = park(packed(own, max(1, min(partitions(spark), n_groups // 4)), shape, GROUP, GROUPS, GroupRow()))
    bands = max(1, -(-n_groups // BAND))
    pages, n_pages = paged(blocks, shape)

    near = search(groups, blocks, pages, n_pages, bands, shape, positives, True)

    def hard(lower: np.ndarray, upper: np.ndarray, found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = np.full((len(lower), positives), NEVER), np.full((len(lower), positives), -NEVER)
        at, score = (found["anchor"].to_numpy(np.int64), found["rank"].to_numpy(np.int64) - 1), found["score"].to_numpy(np.int64)
        lower[at], upper[at] = -((-low * score) // 100), high * score // 100
        return lower, upper

    far = search(park(with_windows(groups, near, hard)), blocks, pages, n_pages, bands, shape, negatives, False)
    known = near.select("grp", "anchor", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = far.select("grp", "anchor", "win", "anchor_id", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(known, ["grp", "anchor", "win"])
    as_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return pairs.select("anchor_id", as_id("positive_id"), F.col("rank").cast("int").alias("rank"), as_id("negative_id"), "positive_score", "negative_score")


def sql() -> str:
    """Every anchor against every row."""
    return """
WITH e AS (SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.u, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.u <> b.u WHERE a.vec_id % 50 = 0),
p AS (SELECT u, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM s JOIN p USING (u) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY u, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""
