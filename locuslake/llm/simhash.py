"""SimHash fingerprints and their near-duplicate groups through a Gray-order hierarchical index.

Distinct fingerprints are sorted by their rank in the reflected Gray code, so that neighbours in the
order share most of their bits, and cut into blocks where the leading bits of the rank change, which are
leading bits of the fingerprint too. A node over a run of the order keeps the AND and the OR of its members: a
bit set in the AND of one node and clear in the OR of another differs between any two of their members.
Counting such bits bounds the distance of two whole groups from below, and pairs of groups over the limit are
pruned before anything below them is looked at. Above the blocks the descent is a chain of equi-joins on the
parent node; inside a pair of blocks it is the same descent in numpy.

Blocks that share no more than k leading bits with others leave C(k, 0) + ... + C(k, limit) of 2^k pairs, so
that the share of pairs that are looked at falls with the number of blocks, and inside of them with their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from locuslake.llm.shared import park

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Least number of leading bits that blocks share; more where a block would exceed MOST_ROWS fingerprints (32 MB).
PREFIX_BITS, MOST_ROWS = 5, 1 << 22
#: Members under a node at each level inside a block.
WIDTHS = (1 << 18, 1 << 15, 4096, 512, 64, 8, 2, 1)
#: Bits of a block number that count the blocks of one range partition, and leading bits that a level above the blocks adds.
CHUNK_BITS, FAN_BITS = 20, 4
#: Fingerprints that a range partition sorts, and tasks that pairs of blocks are dealt to at most.
SORT_ROWS, MOST_TASKS = 1 << 16, 4096
#: Bytes of a text that are taken apart at once.
PIECE = 1 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE = np.arange(8, dtype=np.int64) * 256
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 for null or a text without words.

    A-Z are lower-cased; words split at ASCII white space; every shingle counts as often as it occurs;
    a text with fewer words than a shingle is one shingle. A bit is 1 if over half the hashes have it.
    """
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    digest = xxhash.xxh64_intdigest
    ones, total, kept = np.zeros(64, np.int64), 0, []
    for piece in _pieces(data):
        kept += piece.split()
        if len(kept) < shingle_words:
            continue
        joined = b" ".join(kept)
        lengths = np.fromiter(map(len, kept), np.int64, len(kept))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths).tolist()
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends.tolist()[shingle_words - 1 :], strict=False)], dtype=">u8")
        ones += _bit_counts(hashes)
        total += len(hashes)
        kept = kept[len(kept) - shingle_words + 1 :]
    if not total:
        if not kept:
            return 0
        ones, total = _bit_counts(np.array([digest(b" ".join(kept), 42)], dtype=">u8")), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about PIECE bytes, so that few words are held at once."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the big-endian hashes have each bit, the highest first."""
    octets = hashes.view(np.uint8).reshape(-1, 8) + _BYTE
    return (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """fingerprint() of each text, as a signed 64-bit number with the same bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).astype(np.int64))


def as_hex(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def gray_rank(bits: Column) -> Column:
    """Rank of a fingerprint in the reflected Gray code, shifted so that signed order is rank order."""
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def prefix_bits(count: int, block_rows: int | None = None) -> int:
    """How many leading bits the fingerprints of a block share: so many that evenly spread ones make blocks of at most block_rows."""
    bits = PREFIX_BITS if block_rows is None else 1
    while count >> bits > (block_rows or MOST_ROWS):
        bits += 1
    return bits


def _blocks(batches: Iterator[pd.DataFrame], shared: int, most: int) -> Iterator[pd.DataFrame]:
    """Cuts a partition, sorted by rank, into blocks of one prefix, and of `most` rows at most, with the AND and OR of
    their fingerprints."""
    first = TaskContext.get().partitionId() << CHUNK_BITS
    held, of, chunk = np.empty(0, np.int64), 0, 0

    def row() -> pd.DataFrame:
        return pd.DataFrame({
            "block": [first + chunk], "prefix": [of], "ones": [np.bitwise_and.reduce(held)], "any": [np.bitwise_or.reduce(held)], "bits": [held.tobytes()],
        })

    for batch in batches:
        values = batch["bits"].to_numpy(np.int64)
        prefix = (batch["rank"].to_numpy(np.int64) >> (64 - shared)) + (1 << (shared - 1))
        edges = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(values)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if begin == end:
                continue
            if len(held) and prefix[begin] != of:
                yield row()
                held, chunk = held[:0], chunk + 1
            held, of = np.concatenate([held, values[begin:end]]), int(prefix[begin])
            while len(held) > most:
                rest, held = held[most:], held[:most]
                yield row()
                held, chunk = rest, chunk + 1
    if len(held):
        yield row()


def _nodes(values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.bitwise_and.reduceat(values, at), np.bitwise_or.reduceat(values, at))
        for at in (np.arange(0, len(values), width) for width in WIDTHS)
    ]


def close_pairs(a: np.ndarray, b: np.ndarray, limit: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b that differ in at most limit bits, in pieces; if same, each pair of a once."""
    left, right = _nodes(a.view(np.uint64)), _nodes(b.view(np.uint64))  # bitwise_count of a negative number counts its absolute value

    def near(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (and_a, or_a), (and_b, or_b) = left[level], right[level]
        if WIDTHS[level] == 1:
            return np.bitwise_count(and_a[i] ^ and_b[j]) <= limit
        apart = np.bitwise_count(and_a[i] & ~or_b[j]) + np.bitwise_count(and_b[j] & ~or_a[i])
        return apart <= limit

    ni, nj = len(left[0][0]), len(right[0][0])
    i, j = np.repeat(np.arange(ni), nj), np.tile(np.arange(nj), ni)
    ok = near(0, i, j) & ((i <= j) | (not same))
    stack = [(0, i[ok], j[ok])]
    while stack:
        level, i, j = stack.pop()
        if not len(i):
            continue
        if level == len(WIDTHS) - 1:
            yield i, j
            continue
        if len(i) > 4096:
            stack += [(level, i[4096:], j[4096:])]
            i, j = i[:4096], j[:4096]
        fan = WIDTHS[level] // WIDTHS[level + 1]
        step = np.arange(fan)
        ci = (i[:, None, None] * fan + step[:, None] + 0 * step[None, :]).ravel()
        cj = (j[:, None, None] * fan + 0 * step[:, None] + step[None, :]).ravel()
        ok = (ci < len(left[level + 1][0])) & (cj < len(right[level + 1][0]))
        if same:
            ok &= (ci < cj) if WIDTHS[level + 1] == 1 else (ci <= cj)
        ci, cj = ci[ok], cj[ok]
        ok = near(level + 1, ci, cj)
        stack.append((level + 1, ci[ok], cj[ok]))


def _forest(a: np.ndarray, b: np.ndarray, limit: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest member) with the connectivity of all close pairs of two blocks."""
    values = a if same else np.concatenate([a, b])
    n, shift = len(values), 0 if same else len(a)
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        top = parent[x]
        while (top != (up := parent[top])).any():
            top = up
        parent[x] = top
        return top

    def find(x: int) -> int:
        while (up := int(parent[x])) != x:
            parent[x] = x = int(parent[up])
        return x

    for i, j in close_pairs(a, b, limit, same):
        x, y = roots(i), roots(j + shift)
        for key in np.unique((np.minimum(x, y) * n + np.maximum(x, y))[x != y]).tolist():
            one, other = find(key // n), find(key % n)
            if one != other:
                parent[max(one, other)] = min(one, other)
    label = roots(np.arange(n))
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, values)
    root = least[label]
    linked = root != values
    return values[linked], root[linked]


def _links(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Links of pairs of blocks: the two sides of a pair follow each other, a pair of equals has one side."""
    left = np.empty(0, np.int64)
    for batch in batches:
        for a, b, side, bits in zip(batch["a"], batch["b"], batch["side"], batch["bits"], strict=True):
            values = np.frombuffer(bits, np.int64)
            if side == 0:
                left = values
            if side == 1 or a == b:
                node, to = _forest(left, values, limit, a == b)
                yield pd.DataFrame({"node": node, "to": to})


def block_index(bits: DataFrame, block_rows: int | None = None) -> tuple[DataFrame, int]:
    """Gray-ordered blocks (block, prefix, ones, any, bits) of a frame of distinct fingerprints `bits`, and the bits of a prefix."""
    count = bits.count()
    shared = prefix_bits(count, block_rows)
    ranges = max(1, min(count // SORT_ROWS, 1 << max(shared - 2, 0)))
    ordered = bits.select("bits", gray_rank(F.col("bits")).alias("rank")).repartitionByRange(ranges, "rank").sortWithinPartitions("rank")
    most = max(1, count >> (shared - 1))
    return park(ordered.mapInPandas(lambda it: _blocks(it, shared, most), "block long, prefix long, ones long, any long, bits binary")), shared


def near_blocks(blocks: DataFrame, shared: int, limit: int) -> DataFrame:
    """Pairs of block numbers (a, b), a <= b, that may hold fingerprints within the limit, by descent from one root node.

    blocks: number, prefix, ones, any; a few bytes for each block.
    """

    def below(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of nodes (node, up, ones, any) under pairs of their parents."""
        x, y = nodes.select([F.col(c).alias(f"x_{c}") for c in nodes.columns]), nodes.select([F.col(c).alias(f"y_{c}") for c in nodes.columns])
        apart = F.bit_count(F.col("x_ones").bitwiseAND(F.bitwise_not("y_any"))) + F.bit_count(F.col("y_ones").bitwiseAND(F.bitwise_not("x_any")))
        near = pairs.join(x, F.col("a") == F.col("x_up")).join(y, F.col("b") == F.col("y_up")).filter((F.col("x_node") <= F.col("y_node")) & (apart <= limit))
        return park(near.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))

    pairs, upper = blocks.sparkSession.createDataFrame([(0, 0)], "a long, b long"), 0
    for level in [*range(FAN_BITS, shared, FAN_BITS), shared]:
        nodes = blocks.groupBy(F.shiftright("prefix", shared - level).alias("node")).agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
        pairs, upper = below(pairs, nodes.withColumn("up", F.shiftright("node", level - upper))), level
    return below(pairs, blocks.select(F.col("number").alias("node"), F.col("prefix").alias("up"), "ones", "any"))


def indexed_pairs(bits: DataFrame, limit: int = MAX_DISTANCE, block_rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Blocks with their numbers, pairs of them that may hold links, and the number of such pairs."""
    blocks, shared = block_index(bits, block_rows)
    numbers = park(blocks.select("block", "prefix", "ones", "any").withColumn("number", F.row_number().over(W.orderBy("block")).cast("long") - 1))
    pairs = near_blocks(numbers, shared, limit)
    return blocks.select("block", "bits").join(numbers.select("block", "number"), "block").select("number", "bits"), pairs, pairs.count()


def surviving_share(bits: DataFrame, limit: int = MAX_DISTANCE, block_rows: int | None = None) -> float:
    """The share of all pairs of blocks that the descent leaves."""
    blocks, _, left = indexed_pairs(bits, limit, block_rows)
    n = blocks.count()
    return left / (n * (n + 1) / 2) if n else 0.0


def links(bits: DataFrame, limit: int = MAX_DISTANCE, block_rows: int | None = None) -> DataFrame:
    """Edges (node, to) whose components are those of all pairs of fingerprints within the limit.

    Pairs of blocks are dealt to tasks by their own numbers, which are dense where no pair is pruned, so that
    tasks get equal numbers of pairs; a task holds two blocks at a time.
    """
    blocks, pairs, count = indexed_pairs(bits, limit, block_rows)
    tasks = max(1, min(count, MOST_TASKS))
    slot = F.pmod(F.expr("b * (b + 1) div 2 + a"), F.lit(tasks)).cast("int")
    sides = F.array(F.struct(F.col("a").alias("number"), F.lit(0).alias("side")), F.struct(F.col("b").alias("number"), F.lit(1).alias("side")))
    wanted = pairs.select("a", "b", slot.alias("slot"), F.explode(sides).alias("x")).select("a", "b", "slot", "x.*").filter("side = 0 or a <> b")
    dealt = wanted.join(blocks, "number").repartitionById(tasks, "slot").sortWithinPartitions("a", "b", "side")
    return dealt.select("a", "b", "side", "bits").mapInPandas(lambda it: _links(it, limit), "node long, to long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (node, to), root being the smallest node reachable.

    Alternates large-star and small-star steps until the edges stop changing; each round is written out.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = park(edges.filter("node <> to").select(F.greatest("node", "to").alias("u"), F.least("node", "to").alias("v")).distinct())
    before = state(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = park(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = park(moved.union(least).distinct())
        if (after := state(e)) == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def grouped(own: DataFrame, limit: int = MAX_DISTANCE, block_rows: int | None = None) -> DataFrame:
    """own (doc_id, bits, ...) with root, the fingerprint that stands for the group, and component_id, its smallest id."""
    first = park(own.groupBy("bits").agg(F.min("doc_id").alias("first_id")))
    roots = park(components(links(first.select("bits"), limit, block_rows)).withColumnsRenamed({"node": "bits"}))
    lowest = roots.join(first, "bits").groupBy("root").agg(F.min("first_id").alias("lowest"))
    of_bits = first.join(roots.join(lowest, "root"), "bits", "left").select(
        "bits", F.coalesce("root", "bits").alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("component_id")
    )
    # stored, so that the join deals both sides anew and AQE can split a hot fingerprint
    return own.join(park(of_bits), "bits")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_DISTANCE, block_rows: int | None = None) -> DataFrame:
    """One row (doc_id, bits, component_id) per input row.

    Texts whose fingerprints differ in at most `limit` bits are linked; component_id is the smallest id
    reachable. Null and wordless texts have fingerprint 0 and are linked like any other. Null ids never
    are the smallest unless a component has no other. Repeated rows stay repeated; other columns are
    ignored; an empty table gives none. A text is taken apart in pieces of PIECE bytes, however long it is.
    """
    own = park(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("bits")))
    return grouped(own, limit, block_rows).select("doc_id", "bits", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = MAX_DISTANCE, block_rows: int | None = None) -> DataFrame:
    """The rows of docs that stay when one of each group does: the one with the smallest id, all its columns kept.

    Rows with equal ids in a group are told apart by a hash of their text, and of rows equal in both one stays. Null
    ids stay only in groups without another; an empty table gives none. The texts are shuffled once.
    """
    digest = F.xxhash64(F.lit(6), F.col(text))
    own = park(docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), fingerprints(F.col(text)).alias("bits")))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    first = grouped(own, limit, block_rows).groupBy("root").agg(F.min(order).alias("first"))
    keep = park(first.select(F.col("first.doc_id").alias("keep_id"), F.col("first.digest").alias("keep_digest")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.struct("*").alias("row"))
    # the ids that stay grow with the documents: merged at every size, never broadcast
    kept = rows.join(keep.hint("merge"), same, "left_semi")
    repeated = own.join(keep, same, "left_semi").count() > keep.count()
    return (kept.dropDuplicates(["doc_id", "digest"]) if repeated else kept).select("row.*")
