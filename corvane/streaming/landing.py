"""The same audit over documents that land in a folder, as a stream: stateless projections, and one bounded-state dedupe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit


def landed(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Documents (doc_id, path, content, landed_at) of parquet files as they appear in folder."""
    return spark.readStream.schema("doc_id bigint, path string, content string, landed_at timestamp").option("maxFilesPerTrigger", max_files).parquet(folder)


def scores(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Scores of each path once within `late`: state is kept for no longer than the watermark."""
    once = stream.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["path"])
    return audit.audited(once, ["doc_id", "path", "landed_at"], keep=["profile", "v2_score", "band"])


def band_counts(stream: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Documents by band and window of arrival."""
    return scores(stream, late).groupBy(F.window("landed_at", window), "band").agg(F.count("*").alias("documents"), F.avg("v2_score").alias("average"))
