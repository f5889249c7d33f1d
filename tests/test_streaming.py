"""Streams in several batches: late rows, closed windows, state that stays bounded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from locuslake.streaming import incremental

SCHEMA = "ts timestamp, event_type string, event_id long, value double"


def batches(spark, tmp_path, *parts):
    """A stream that reads one file in each batch, in the order given."""
    for k, rows in enumerate(parts):
        spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), e, k * 1000 + j, v) for j, (h, m, e, v) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_rows_are_dropped_and_windows_leave_the_state(spark, tmp_path):
    first = [(h, 5, "a", 1.0) for h in range(8, 13)]
    second = [(9, 30, "a", 100.0), (12, 30, "a", 1.0), (16, 0, "a", 1.0)]  # the window of 9 o'clock is closed by then
    stream = batches(spark, tmp_path, first, [(12, 10, "a", 1.0)], second)  # rows are held against the watermark of the batch before
    query = (
        incremental.windowed(stream, "1 hour").writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}")))
        .outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = sorted((r["start"].hour, r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(8, 1, 1.0), (9, 1, 1.0), (10, 1, 1.0), (11, 1, 1.0), (12, 3, 3.0)]
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1 and states[-1]["numRowsTotal"] == 1


def test_moving_state_over_batches_and_its_expiry(spark, tmp_path):
    stream = batches(spark, tmp_path, [(8, k, "a", float(k)) for k in range(30)] + [(8, 0, "b", 5.0)], [(9, k, "a", 100.0) for k in range(4)])
    got = []
    query = (
        incremental.moving_state(stream, "event_type", "event_id", "value", 10).writeStream.foreachBatch(lambda b, n: got.append((n, sorted(tuple(r) for r in b.select("key", "n", "mean").collect()))))
        .outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    last = {key: (n, mean) for _, rows in got for key, n, mean in rows}
    assert last == {"a": (10, (24 + 25 + 26 + 27 + 28 + 29 + 400) / 10), "b": (1, 5.0)}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == 2


def test_silent_keys_are_forgotten(spark, tmp_path):
    """An hour after its last row a key's state goes with the watermark, and begins anew with its next row."""
    stream = batches(spark, tmp_path, [(0, 0, "gone", 1.0), (0, 0, "here", 1.0)], *[[(h, 0, "here", 1.0)] for h in (4, 8, 12)], [(12, 30, "gone", 7.0)])
    got = []
    query = (
        incremental.moving_state(stream, "event_type", "event_id", "value", 10, "ts", "1 hour").writeStream.foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.select("key", "n", "mean").collect()))
        .outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert min(sizes[2:]) == 1 and got[-1] == ("gone", 1, 7.0)


def test_a_correlation_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [(8, k, "a", float(k % 7)) for k in range(20)], [(9, k, "a", float(k % 5)) for k in range(20)])
    out = incremental.run_once(incremental.running_sums(stream.withColumn("y", F.col("value") * 2 + 1), ["event_type"], "value", "y"), str(tmp_path / "out"), "complete", str(tmp_path / "c"))
    assert [(r["n"], round(r["corr"], 5)) for r in incremental.correlation(out).collect()] == [(40, 1.0)]
