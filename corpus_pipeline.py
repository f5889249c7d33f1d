"""A corpus pipeline of five operators; each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, further columns of docs included, whatever
their names. An empty table stays empty in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuslake.llm import decontaminate, langid, mixing, sharding, simhash
from locuslake.llm.shared import fold, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null, empty and letterless texts are rejected, as are all where no
    document has a language to learn from.

    A null id is in no held-out fold, a null lang teaches nothing, languages at equal distance all count as
    identified, and repeated rows stay repeated.
    """
    profiles = langid.learn(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return docs.filter(langid.classifier(profiles)(F.col("text"))["lang_pred"] != langid.UNKNOWN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    As in the operator, shingles take four words and fingerprints link at 4 differing bits or fewer. Null, empty and
    wordless texts have one fingerprint and are one group; a null id stays only where its group has no other; rows with
    equal ids are told apart by their texts, and of repeated rows one stays.
    """
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, repeated rows stay or go together, and
    all rows stay where the benchmark is empty."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Null and empty texts have no words and are taken once, a null source is one of its own, and repeated rows are
    taken independently of each other.
    """
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every copy of a document, without its text: columns doc_id, lang, source, size, text_crc32,
    shard and slot.

    A null text counts as empty, a null source is one of its own, and rows equal in id and text are interchangeable,
    each with a slot of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", sharding.text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.interleave(rows, "source", ["doc_id", "text_crc32", "size"])


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
    ("shard", deal_shards),
]

#: Fingerprints, retrieval and the dual solution have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
