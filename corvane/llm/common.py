"""Helpers shared by the training-data operators: the shared folder, written tables, and small files for executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table as read_table  # noqa: F401

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only a session without one (tests) gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        held = jsc.getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(folder)
        return jsc.getCheckpointDir().get()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and a lost executor costs nothing of it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._corvane_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads."""
    path = getattr(df, "_corvane_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Write data to the shared folder and hand it to every executor; returns the name for SparkFiles.get()."""
    path = f"{fresh_path(spark, 'file')}-{name}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 4 << 20):
            out.write(bytearray(data[i : i + (4 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_order_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """The `bound` rows whose key hashes lowest: a bounded sample that is the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(bound)
