"""The blob data source: partitions, pushed filters, and blobs of both kinds."""

from __future__ import annotations

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from locuslake.operators import coverage
from locuslake.sources import blob_source


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blobs") / "store")
    rows = [(f"chr{c}", 10 * w + b, b % 3, float(b + c)) for c in range(1, 5) for w in range(6) for b in range(0, 10, 2)]
    cov = spark.createDataFrame(rows, "chrom string, bin long, row_id int, value double")
    blob_source.write_blobs(cov, path, "p", 100, 10, 3)
    return path, rows


def test_partitions_and_rows(spark, store):
    path, rows = store
    frame = blob_source.read_blobs(spark, path, "p", 100)
    assert frame.rdd.getNumPartitions() == 3
    assert sorted((r["chrom"], r["bin"], r["row_id"], r["value"]) for r in frame.collect()) == sorted(rows)


@pytest.mark.parametrize("where,want", [
    ("chrom = 'chr2'", lambda c, w: c == 2), ("region = 'chr3:1000-2000'", lambda c, w: c == 3 and w == 1), ("region in ('chr1:0-1000', 'chr4:5000-6000') and value > 0", lambda c, w: (c, w) in ((1, 0), (4, 5))),
    ("region like 'chr1:%' and chrom in ('chr1', 'chr2')", lambda c, w: c == 1), ("chrom = 'chr9'", lambda c, w: False),
])
def test_filters_are_pushed(spark, store, where, want):
    path, rows = store
    frame = blob_source.read_blobs(spark, path, "p", 100).filter(where)
    got = sorted((r["chrom"], r["bin"], r["row_id"], r["value"]) for r in frame.collect())
    assert got == sorted(r for r in rows if want(int(r[0][3:]), r[1] // 10))
    scan = [x for x in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "BatchScan" in x]
    assert len(scan) == 1
    reader = blob_source.BlobReader({"path": path, "prefix": "p", "resolution": "100"})
    assert [p.path[-8:] for p in reader.partitions()] == [".parquet"] * 3


def test_only_wanted_blobs_are_unpacked(store, monkeypatch):
    """The reader without Spark: blobs of other regions are never unpacked."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    path, _ = store
    reader = blob_source.BlobReader({"path": path, "prefix": "p", "resolution": "100"})
    left = list(reader.pushFilters([EqualTo(("region",), "chr3:1000-2000"), GreaterThan(("value",), 1.0), In(("chrom",), ("chr3", "chr4"))]))
    assert left == [GreaterThan(("value",), 1.0)]
    unpacked, inner = [], blob_source.cells
    monkeypatch.setattr(blob_source, "cells", lambda blobs, dtypes: unpacked.append(1) or inner(blobs, dtypes))
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert len(unpacked) == 1 and [b["region"][0].as_py() for b in batches] == ["chr3:1000-2000"]


def test_both_kinds_of_matrix():
    pack = lambda x, t: gzip.compress(np.array(x, t).tobytes())
    dense = {"data": pack([[0, 2, 0], [3, 0, 4]], "float32"), "shape": pack([2, 3], "uint32")}
    sparse = {"indices": pack([1, 0, 2, 2], "uint32"), "indptr": pack([0, 1, 4], "uint32"), "data": pack([2, 3, 4, 0], "float32"), "shape": pack([2, 3], "uint32")}
    dtypes = {"data": "float32", "shape": "uint32", "indices": "uint32", "indptr": "uint32"}
    for blobs in (dense, sparse):
        assert [x.tolist() for x in blob_source.cells(blobs, dtypes)] == [[0, 1, 1], [1, 0, 2], [2, 3, 4]]
    assert [len(x) for x in blob_source.cells({"data": pack([], "float32"), "shape": pack([0, 3], "uint32")}, dtypes)] == [0, 0, 0]


def test_manifest_and_order(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 7919 % 500).alias("x"))
    df.repartitionByRange(5, "x").sortWithinPartitions("x").write.parquet(path)
    read = coverage.read_in_order(spark, path)
    assert [r["x"] for r in read.orderBy("row_order").collect()] == list(range(500)) and sorted(r["row_order"] for r in read.collect()) == list(range(500))
    assert "Exchange" not in read.select("x", F.col("row_order"))._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert [r["x"] for r in coverage.in_row_order(read.repartition(7, "k")).collect()] == list(range(500))
    places = coverage.manifest(spark, path, "x").filter("x in (3, 250, 499)")
    assert places.count() == 3 and sorted(r["x"] for r in coverage.rows_at(spark, path, places).collect()) == [3, 250, 499]


def read_rows(frame) -> int:
    """How many rows the scan of a frame gives out when it is run."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_lookups_read_little(spark, tmp_path):
    """A join moves the keys only; one key reads one bucket, and of it the row groups that its bloom filters leave."""
    rows = spark.range(20_000).select(F.format_string("n%05d", F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("name"), "id").dropDuplicates(["name"])
    n = rows.count()
    coverage.write_lookup(rows, str(tmp_path / "t"), "lookup_test", "name", 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = rows.filter("id % 7 = 0").select("name").unionByName(rows.filter("id = 0").select("name"))
        found = coverage.look_up(spark, "lookup_test", wanted, "name")
        store = found._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].split("lookup_test")[0]
        assert "Exchange" not in store and "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == rows.filter("id % 7 = 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        name = rows.first()["name"]
    one = coverage.look_up(spark, "lookup_test", [name], "name")
    assert [r["name"] for r in one.collect()] == [name]
    assert "EqualTo(name," in one._jdf.queryExecution().executedPlan().toString() and read_rows(one) < 0.6 * n
    # unsorted, in small row groups: without bloom filters every group's range holds the name
    path = str(tmp_path / "loose")
    loose = rows.orderBy(F.xxhash64("name")).coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.row.count.limit", 100)
    loose.option("parquet.bloom.filter.enabled#name", "true").option("parquet.bloom.filter.expected.ndv#name", 500).parquet(path)
    scan = spark.read.parquet(path).filter(F.col("name") == name)
    assert scan.count() == 1
    assert read_rows(scan) < n / 4
    spark.sql("DROP TABLE lookup_test")
