"""Tables as they are stored, in as many partitions as the session has cores at least."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame, SparkSession


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of what is stored under path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table. Where it is too small to give every core a split of spark.sql.files.maxPartitionBytes, its rows are dealt out:
    a small file is often one row group, which is one task whatever the splits. Larger tables aren't shuffled."""
    path = f"{folder}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if cores > 1 and stored_bytes(spark, path) < cores * split else df


def slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many rows and bytes of a text column at most, a longer text by itself: what a worker holds as Python objects doesn't depend on the batch."""
    at = total = 0
    for i, n in enumerate(compute.binary_length(batch.column(column)).to_pylist()):
        if i > at and (i - at >= rows or total + (n or 0) > size):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)
