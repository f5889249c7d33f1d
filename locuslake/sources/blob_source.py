"""A Spark data source for coverage stored as blobs: spark.read.format("coverage_blobs").

A store is a folder of Parquet files with a row for each window: its region "chrom:start-end", and gzipped arrays of a
window's matrix in columns "prefix:part+dtype". Options: path, prefix, resolution. Rows of the
source are the non-zero cells, with bins counted from the chromosome's start. Every file is an input partition, read row
group by row group; equality and membership filters on region and chrom are taken over, so that only blobs of
the regions asked for are read from disk and unpacked.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

NAME = "coverage_blobs"
SCHEMA = "prefix string, region string, chrom string, row_id int, bin long, value double"


@dataclass
class BlobFile(InputPartition):
    path: str


def cells(blobs: dict[str, bytes], dtypes: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the non-zero cells of a matrix: sparse (indices, indptr, data, shape) or dense (data, shape)."""
    arrays = {part: np.frombuffer(gzip.decompress(blob), dtypes[part]) for part, blob in blobs.items() if blob is not None}
    rows, width = (int(x) for x in arrays["shape"])
    if "indptr" in arrays:
        row, column, value = np.repeat(np.arange(rows), np.diff(arrays["indptr"])), arrays["indices"].astype(np.int64), arrays["data"]
    else:
        dense = arrays["data"].reshape(rows, width)
        row, column = np.nonzero(dense)
        value = dense[row, column]
    kept = value != 0
    return row[kept], column[kept], value[kept]


class BlobReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.prefix, self.resolution = options["path"], options["prefix"], int(options["resolution"])
        self.regions: set[str] | None = None
        self.chroms: set[str] | None = None
        self.starts: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("region",):
                self.regions = values if self.regions is None else self.regions & values
            elif values is not None and f.attribute == ("chrom",):
                self.chroms = values if self.chroms is None else self.chroms & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("region",):
                self.starts.append(f.value)
            else:
                yield f

    def _files(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, root

    def partitions(self) -> list[BlobFile]:
        from pyarrow import fs

        system, root = self._files()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith(".parquet"))
        return [BlobFile(x) for x in names] or [BlobFile("")]

    def _wanted(self, region: str) -> bool:
        return (
            (self.regions is None or region in self.regions) and (self.chroms is None or region.rpartition(":")[0] in self.chroms)
            and all(region.startswith(x) for x in self.starts)
        )

    def read(self, partition: BlobFile) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.path:
            return
        with pq.ParquetFile(self._files()[0].open_input_file(partition.path)) as file:
            columns = {c.split(":")[1].split("+")[0]: c for c in file.schema_arrow.names if c.startswith(f"{self.prefix}:")}
            dtypes = {part: c.rpartition("+")[2] for part, c in columns.items()}
            for group in range(file.num_row_groups):
                # names first: blobs are read from the groups that hold a region asked for
                names = file.read_row_group(group, columns=["region"])["region"].to_pylist()
                if not any(map(self._wanted, names)):
                    continue
                for batch in file.iter_batches(16, row_groups=[group], columns=["region", *columns.values()]):
                    for row in batch.to_pylist():
                        if self._wanted(row["region"]):
                            yield self._rows(row["region"], {part: row[c] for part, c in columns.items()}, dtypes)

    def _rows(self, region: str, blobs: dict[str, bytes], dtypes: dict[str, str]) -> pa.RecordBatch:
        row, column, value = cells(blobs, dtypes)
        chrom, _, span = region.rpartition(":")
        n, first = len(row), int(span.split("-")[0]) // self.resolution
        return pa.record_batch({
            "prefix": pa.array([self.prefix] * n, pa.string()), "region": pa.array([region] * n, pa.string()), "chrom": pa.array([chrom] * n, pa.string()),
            "row_id": pa.array(row, pa.int32()), "bin": pa.array(column + first, pa.int64()), "value": pa.array(value.astype(float), pa.float64()),
        })


class CoverageBlobs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlobReader:
        return BlobReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CoverageBlobs)


def read_blobs(spark: SparkSession, path: str, prefix: str, resolution: int) -> DataFrame:
    """A store through the source. Spark keeps one set of pushed filters for each load: where a plan reads a store under
    several filters, load it for each of them."""
    register(spark)
    return spark.read.format(NAME).options(path=path, prefix=prefix, resolution=resolution).load()


def write_blobs(coverage: DataFrame, path: str, prefix: str, resolution: int, bins: int, files: int, per_group: int = 8) -> None:
    """Writes coverage (chrom, bin, row_id, value) as a blob store: windows of `bins` bins, each a sparse matrix.

    A window is a bounded group: its cells are the rows of one stretch of the genome.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    parts = {"indices": "uint32", "indptr": "uint32", "data": "float32", "shape": "uint32"}
    columns = [f"{prefix}:{part}+{dtype}" for part, dtype in parts.items()]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_id", "bin"])
        start = int(frame["window"].iloc[0]) * bins
        rows = int(frame["row_id"].max()) + 1
        indptr = np.concatenate([[0], np.cumsum(np.bincount(frame["row_id"], minlength=rows))])
        arrays = {"indices": frame["bin"].to_numpy() - start, "indptr": indptr, "data": frame["value"].to_numpy(), "shape": np.array([rows, bins])}
        region = f"{frame['chrom'].iloc[0]}:{start * resolution}-{(start + bins) * resolution}"
        return pd.DataFrame([[region, *[gzip.compress(arrays[part].astype(dtype).tobytes()) for part, dtype in parts.items()]]], columns=["region", *columns])

    windows = coverage.withColumn("window", F.floor(F.col("bin") / bins)).groupBy("chrom", "window").applyInPandas(pack, "region string, " + ", ".join(f"`{c}` binary" for c in columns))
    (windows.repartitionByRange(files, "region").sortWithinPartitions("region").write.option("parquet.block.row.count.limit", per_group).mode("overwrite").parquet(path))
