"""Registered streaming queries: each reads its table as a file stream to its end and matches its batch twin in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuslake.plans import views
from locuslake.sources.store import shared_folder
from locuslake.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream, whether it is one file or a folder; ts is a timestamp of the session's zone."""
    out = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = views.with_views(sql)
        return f

    return add


def run(spark: SparkSession, out: DataFrame, mode: str) -> DataFrame:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return incremental.run_once(out, f"{base}/out", mode, f"{base}/checkpoint")


@query("t1_running_corr", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(corr(l_quantity, l_extendedprice), 5) AS corr FROM lineitem GROUP BY 1, 2")
def t1(spark, sf_dir):
    sums = incremental.running_sums(stream(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice")
    return incremental.correlation(run(spark, sums, "complete")).select("l_returnflag", "l_linestatus", "n", F.round("corr", 5).alias("corr"))


@query("t2_moving_state", "SELECT event_type AS key, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_samp(value), 6) AS std FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100) x GROUP BY 1")
def t2(spark, sf_dir):
    out = run(spark, incremental.moving_state(stream(spark, sf_dir, "events"), "event_type", "event_id", "value"), "update")
    return out.select("key", "n", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"))


@query("t3_process_once", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def t3(spark, sf_dir):
    base = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    keys = stream(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    for k in range(2):  # the second run finds all keys done
        incremental.process_once(keys, ["l_orderkey", "l_linenumber"], f"{base}/out", f"{base}/checkpoint{k}").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("l_orderkey", "l_linenumber")


@query("t4_grow_store", """WITH i AS (SELECT sample, cell, chrom, st AS pos FROM v_frag UNION ALL SELECT sample, cell, chrom, en - 1 FROM v_frag)
SELECT sample, cell, chrom, CAST(floor(pos / 100) AS BIGINT) AS bin, count(*) AS value FROM i GROUP BY 1, 2, 3, 4""")
def t4(spark, sf_dir):
    base = f"{shared_folder(spark)}/grown-{uuid.uuid4().hex}"
    start = F.col("l_partkey") * 100 + F.col("l_suppkey") * 7
    fragments = stream(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), F.col("l_linenumber")).alias("chrom"), start.alias("start"), F.floor(start + F.col("l_quantity") * 5).alias("end"), F.col("l_suppkey").alias("cell"), F.col("l_returnflag").alias("sample"))
    incremental.grow_store(fragments, f"{base}/out", f"{base}/checkpoint", 100).awaitTermination()
    return incremental.read_grown(spark, f"{base}/out")


@query("t5_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t5a(spark, sf_dir):
    return run(spark, incremental.windowed(stream(spark, sf_dir, "events"), "1 hour"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t5_closed_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def t5d(spark, sf_dir):
    """Append mode: the windows that the watermark has closed, each written once."""
    return run(spark, incremental.windowed(stream(spark, sf_dir, "events"), "1 hour"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t5_sliding", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest(range(0, 4)) AS k) x GROUP BY 1, 2")
def t5b(spark, sf_dir):
    return run(spark, incremental.windowed(stream(spark, sf_dir, "events"), "1 hour", "15 minutes"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("t5_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def t5c(spark, sf_dir):
    out = run(spark, incremental.sessions(stream(spark, sf_dir, "events"), "30 minutes"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
