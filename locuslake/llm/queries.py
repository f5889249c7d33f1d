"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuslake.llm import decontaminate, filter_audit, hard_negatives, langid, licenses, mixing, ordinal, quality_rules, sharding, simhash, token_counts, toxicity, warc
from locuslake.llm.shared import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs.filter(~held_out), labels.filter(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", sharding.text_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.interleave(rows, "source", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", "position")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    profiles = langid.learn(docs.filter(~held_out))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ratings = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("quality", "grade")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = ordinal.learn(docs, ratings.filter(~held_out))
    return ordinal.select(docs, model, model.grades[-1]).withColumn("held_out", held_out)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), relabel=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_warc_index": op7_warc_index,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_quality_grade": op10_quality_grade,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_filter_audit": op13_filter_audit,
}

_BITS = "CAST(from_hex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR"
_LETTER = " + ".join(f"CAST(substr(b, 5 * i + {k + 1}, 1) AS INTEGER) * {16 >> k}" for k in range(5))

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.sql(),
    "op11_hard_negatives": hard_negatives.sql(),
    "op13_filter_audit": filter_audit.sql(),
    "op7_warc_index": f"""
WITH bits AS (SELECT page_id, strlen(coalesce(html, '')) AS n, {_BITS} AS b, split_part(lower(trim(coalesce(url, 'about:blank'))), '#', 1) AS u FROM pages),
own AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, strftime(make_timestamp(({warc.EPOCH} + page_id % 1000000000) * 1000000), '%Y%m%d%H%M%S') AS timestamp,
  concat(array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, '://([^/?]*)', 1), '^www\\.', ''), '.')), ','), ')', coalesce(nullif(regexp_extract(u, '://[^/?]*([^?]*)', 1), ''), '/'), regexp_extract(u, '\\?.*$')) AS urlkey,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_LETTER} AS INTEGER) + 1, 1)), '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, urlkey, timestamp, row_number() OVER (ORDER BY urlkey, timestamp, page_id) - 1 AS position,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM own WINDOW w AS (PARTITION BY payload_digest)""",
}
