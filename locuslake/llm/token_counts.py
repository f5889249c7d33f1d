"""Token counts of whole texts by overlap resynchronisation.

A short text is encoded at once. A huge one is cut into chunks that overlap by OVERLAP characters and are encoded apart,
in any task. Neighbours are spliced at a boundary of pre-tokens that both have in their overlap:

* The vocabularies taken apart (byte-level BPE with its own pattern, no normaliser) read pre-tokens from left to
  right, none of which looks behind itself, and merge inside of pre-tokens only. What follows a boundary depends on the
  text after it alone.
* A pre-token ends where the next few characters say so: MARGIN of them cover every alternative of the pattern and the
  longest special token. Boundaries of a chunk are therefore those of the whole text from its first true one up to
  MARGIN characters before its end.
* The first chunk begins with the text. Where its successor has a boundary in common with it, that is a true one, and so
  on to the last chunk.

Where two neighbours have no boundary in common (one pre-token longer than the overlap), the text is cut anew with wider
overlaps, up to the whole text in one chunk. Vocabularies of other kinds have no such proof; their texts are never cut.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from locuslake.llm.shared import park

#: Characters from one chunk's start to the next one's, characters that neighbours share, and how much wider an overlap gets.
CHUNK, OVERLAP, WIDER = 1 << 15, 512, 8
#: The pattern looks three characters ahead at most; special tokens add their length.
MARGIN = 4
LIMIT = 1024
#: Texts handed to the library at once.
BATCH = 128


@lru_cache(maxsize=4)
def load(vocabulary: str):
    """The tokenizer of a file, or of a name that the installed collection of public vocabularies knows; and how many
    characters before a chunk's end its boundaries hold, None if there is no proof for this kind."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.sep not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    spec = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    provable = (
        spec["model"].get("type") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor") and not spec["model"].get("dropout")
        and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    )
    tokenizer = Tokenizer.from_file(str(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, MARGIN + max([len(t["content"]) for t in added], default=0) if provable else None


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Starts and ends of the chunks of a text; all but the last end before the text does."""
    starts = [0, *range(chunk, length - overlap, chunk)]
    return [(s, min(length, s + chunk + overlap)) for s in starts]


def boundaries(encoding, indexes: Iterable[int], beyond: Callable[[int], bool]) -> list[tuple[int, int]]:
    """(character, tokens before it) of the starts of pre-tokens among the tokens asked for, up to a character beyond
    what is wanted. Tokens are looked up one by one, since lists of all of them take longer than encoding."""
    found = []
    for k in indexes:
        start = encoding.token_to_chars(k)[0]
        if beyond(start):
            break
        if k == 0 or (encoding.token_to_word(k) != encoding.token_to_word(k - 1) and encoding.token_to_chars(k - 1)[1] == start):
            found.append((start, k))
    return found


def count_tokens(text: Column, vocabulary: str) -> Column:
    """Tokens of each text encoded at once; a null text counts as empty."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer, _ = load(vocabulary)
        for texts in batches:
            rows = texts.fillna("").tolist()
            yield pd.Series([len(e) for k in range(0, len(rows), BATCH) for e in tokenizer.encode_batch_fast(rows[k : k + BATCH], add_special_tokens=False)], dtype="int64")

    return count(text)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """texts (key, text) as (key, chunk, start, final, piece), one row for each distinct text and chunk."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                spans = cuts(len(text), chunk, overlap)
                for k in range(0, len(spans), BATCH):
                    part = range(k, min(k + BATCH, len(spans)))
                    yield pd.DataFrame({
                        "key": [key] * len(part), "chunk": list(part), "start": [spans[j][0] for j in part],
                        "final": [j == len(spans) - 1 for j in part], "piece": [text[slice(*spans[j])] for j in part],
                    })

    pieces = texts.mapInPandas(cut, "key binary, chunk long, start long, final boolean, piece string")
    # copies of a text agree in key and chunk: one of them is encoded, wherever it is
    return pieces.groupBy("key", "chunk").agg(*[F.first(c).alias(c) for c in ("start", "final", "piece")])


def _encoded(pieces: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """Each chunk's number of tokens and the boundaries in what it shares with its neighbours: two arrays of places in the
    whole text and two of the tokens before them."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, margin = load(vocabulary)
        for batch in batches:
            out = []
            for key, k, start, final, piece in batch.itertuples(index=False, name=None):
                encoding = tokenizer.encode(piece, add_special_tokens=False)
                n, shared, safe = len(encoding), len(piece) - overlap, len(piece) - margin
                left = boundaries(encoding, range(n), lambda at: at > overlap) if start else []
                right = [] if final else [x for x in reversed(boundaries(encoding, range(n - 1, -1, -1), lambda at: at < shared)) if x[0] <= safe]  # noqa: B023
                out.append((key, k, final, n, [start + x[0] for x in left], [x[1] for x in left], [start + x[0] for x in right], [x[1] for x in right]))
            yield pd.DataFrame(out, columns=["key", "chunk", "final", "n", "left_at", "left_n", "right_at", "right_n"])

    schema = "key binary, chunk long, final boolean, n long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"
    return pieces.select("key", "chunk", "start", "final", "piece").mapInPandas(encode, schema)


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens, failed) of each text: a chunk's tokens count up to the seam with the next one, where the next one's
    go on. A text's chunks are a few numbers each, a small part of the text that was one value before."""
    after = W.partitionBy("key").orderBy("chunk")
    seams = encoded.withColumns({"next_at": F.lead("left_at").over(after), "next_n": F.lead("left_n").over(after)})
    seams = seams.withColumn("at", F.try_element_at(F.array_intersect("right_at", "next_at"), F.lit(1)))
    tokens = lambda where, n: F.element_at(n, F.array_position(where, F.col("at")).cast("int"))
    gain = F.when(F.col("final"), F.col("n")).when(F.col("at").isNotNull(), tokens(F.col("right_at"), F.col("right_n")) - tokens(F.col("next_at"), F.col("next_n")))
    return seams.withColumn("gain", gain).groupBy("key").agg(F.sum("gain").alias("n_tokens"), F.max(F.col("gain").isNull()).alias("failed"))


def huge_counts(texts: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of each distinct text of texts (key, text), key being the text's digest."""
    resolved = None
    while True:
        spliced = park(_spliced(_encoded(_chunks(texts, chunk, overlap), vocabulary, overlap)))
        good = spliced.filter("not failed").select("key", "n_tokens")
        resolved = good if resolved is None else resolved.unionByName(good)
        failed = spliced.filter("failed").select("key")
        if failed.isEmpty():
            return resolved
        texts = texts.join(failed, "key", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, overlap)


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, as the vocabulary's library counts the whole text.

    Null and empty texts have no tokens, repeated rows stay repeated, a null id stays null and further columns are
    ignored. An empty table gives none. `vocabulary` is a path that all executors have, or a name among the installed
    public vocabularies.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    whole = lambda x: x.select("doc_id", "n_bytes", count_tokens(F.col("text"), vocabulary).alias("n_tokens"))
    is_huge = F.length("text") > chunk + overlap
    if load(vocabulary)[1] is None:
        counted = whole(rows)
    else:
        huge = rows.filter(is_huge).withColumn("key", F.unhex(F.sha2("text", 256)))
        counts = huge_counts(huge.select("key", "text"), vocabulary, chunk, overlap)
        counted = whole(rows.filter(~is_huge)).unionByName(huge.select("doc_id", "n_bytes", "key").join(counts, "key").drop("key"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
