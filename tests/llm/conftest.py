from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
CLASH = ["size", "bits", "shard", "slot", "target", "copies", "rate", "key", "tie", "at", "score", "votes", "root", "component_id", "row", "_row", "_id", "_rank", "_range", "p", "kept", "item_id"]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(1)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(50)) for _ in range(30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one two three", "en", None), (None, "one two three", "fr", "b"),
        (5, long, "en", "b"), (6, "one two three", "en", "b"), (6, "one two three", "en", "b"), (7, "é ß 語", "de", "a"), (None, None, None, None), (8, "12 34 !!", "en", "a"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df.withColumns({"a.b": F.lit(1), "a": F.struct(F.lit(2).alias("b")), "m": F.create_map(F.lit("k"), F.lit("v")), "m`s": F.array(F.create_map(F.lit(1), F.lit(2)))})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
