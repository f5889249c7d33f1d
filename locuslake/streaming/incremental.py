"""Structured Streaming versions of cumulative metrics, moving metrics, store growth and windowed coverage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_sums(stream: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The five sums a correlation needs, kept per key as batches arrive."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * b).alias("sxy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"))


def correlation(sums: DataFrame) -> DataFrame:
    """sums with corr, on demand."""
    n = F.col("n")
    c = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (F.sqrt(F.col("sxx") - F.col("sx") * F.col("sx") / n) * F.sqrt(F.col("syy") - F.col("sy") * F.col("sy") / n) + F.lit(1e-7))
    return sums.withColumn("corr", c)


def moving_state(stream: DataFrame, key: str, order: str, value: str, size: int = 100, ts: str | None = None, expiry: str = "1 day") -> DataFrame:
    """(key, n, mean, std) of each key's last `size` values by order, after every batch that has rows of the key.

    The state of a key is those values. With an event time `ts` a key is forgotten once the watermark has passed its last
    row by `expiry`, so that keys that stop leave nothing behind; rows later than that are dropped.
    """
    wait = int(pd.Timedelta(expiry).total_seconds() * 1000)

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = list(zip(*state.get[:2], strict=True)) if state.exists else [], state.get[2] if state.exists else 0
        for batch in batches:
            # never more than what stays and one batch
            held = sorted([*held, *zip(batch["order"].astype(float), batch["value"].astype(float), strict=True)])[-size:]
            last = max(last, int(batch["ms"].max()))
        if ts is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        state.update(([x for x, _ in held], [x for _, x in held], last))
        v = pd.Series([x for _, x in held], dtype=float)
        yield pd.DataFrame({"key": [str(name[0])], "n": [len(v)], "mean": [v.mean()], "std": [v.std()]})

    rows = stream if ts is None else stream.withWatermark(ts, expiry)
    ms = F.lit(0).cast("long") if ts is None else F.unix_millis(F.col(ts))
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(order).cast("double").alias("order"), F.col(value).cast("double").alias("value"), ms.alias("ms"), *([] if ts is None else [F.col(ts)]))
    timeout = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, mean double, std double", "orders array<double>, recent array<double>, last long", "update", timeout)


def grow_store(stream: DataFrame, path: str, checkpoint: str, resolution: int):
    """Adds arriving fragments (sample, cell, chrom, start, end) to a coverage table under path, a directory per batch,
    so that a batch run again replaces its own output. Read it with read_grown()."""
    from locuslake.operators.coverage import insertions, rebin

    def add(batch: DataFrame, number: int) -> None:
        bins = rebin(insertions(batch, ["sample", "cell"]), ["sample", "cell", "chrom"], resolution)
        bins.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_grown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("sample", "cell", "chrom", "bin").agg(F.sum("value").alias("value"))


def process_once(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """Writes each key's rows once: keys already under path are skipped, and a batch run again replaces its output."""
    spark: SparkSession = stream.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(key)
        try:
            done = spark.read.parquet(path).filter(F.col("batch") != number)
            new = new.join(done.select(*key).distinct(), key, "left_anti")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(start, key, n, total) per tumbling or sliding window.

    In a stream run in append mode a window is given out once, when the watermark (the latest ts so far less the delay) has
    passed its end; its state is dropped then, and so are rows that come for it later. In complete mode all windows stay.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) per session: rows of a key with no gap as long as `gap` between them."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a streaming query over what is there and returns its result as written under path, a directory per batch.

    In complete mode a batch is the whole result and replaces the one before. No row passes through the driver.
    """
    spark, schema = stream.sparkSession, stream.schema
    # there from the start, so that a stream without rows has a result too
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*schema.names)
