"""The registry of evidence that findings refer to: missing references by anti-join, stale entries by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ("strong", "probable", "experimental", "heuristic")
#: (id, date of the last look at the source)
EVIDENCE = (
    ("geo-kdd-2024", "2026-08-01"), ("what-gets-cited-2025", "2026-08-01"), ("google-ai-guide-2025", "2026-06-27"), ("google-canonical-2025", "2026-06-27"),
    ("google-robots-meta-2025", "2026-06-27"), ("google-hreflang-2025", "2026-06-27"), ("google-structured-data-2025", "2026-06-27"),
)
EVIDENCE_SQL = "(VALUES " + ", ".join(f"('{i}', DATE '{d}')" for i, d in EVIDENCE) + ") AS evidence(id, verified)"


def registry(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {EVIDENCE_SQL}")


def missing_refs(found: DataFrame, key: str, refs: str = "source_refs") -> DataFrame:
    """(key, ref): references that the registry lacks."""
    return found.select(key, F.explode(refs).alias("ref")).distinct().join(registry(found.sparkSession).select(F.col("id").alias("ref")), "ref", "left_anti").select(key, "ref")


def stale(spark: SparkSession, now: str, days: int = 180) -> DataFrame:
    """(id, age): entries not looked at for more than `days` days at the date now."""
    return registry(spark).select("id", F.datediff(F.lit(now).cast("date"), "verified").cast("bigint").alias("age")).where(F.col("age") > days)


def checked(found: DataFrame) -> DataFrame:
    """found, failing when a row has no category, or a severity or label that doesn't exist."""
    fine = (F.col("category") != "") & F.col("severity").isin("pass", "warn", "fail", "not_applicable") & F.col("evidence_label").isin(*LABELS)
    return found.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit("a finding without category, or of unknown severity or label"))))
