"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the shared
folder and gives it, read again, to the next. All stages but the last return the columns of documents; n_chars follows the text.
SQL can't express the first, third and last stage, so ORACLE_SQL is None and tests hold stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, dart_minhash, fm_index, line_dedup, pu_quality
from corvane.llm.common import read_table, written


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as the length of its text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't reject; those without anything but white space go."""
    return pu_quality.kept(docs, pu_quality.trained(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line runs that an earlier place has; a document that loses all its lines goes."""
    return _counted(line_dedup.line_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of every group of near duplicates; documents without a doc_id stay."""
    gone = written(dart_minhash.near_duplicates(docs).select(F.col("doc_id").alias("__gone")), "gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__gone"], "left_anti")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is nothing else goes."""
    return _counted(fm_index.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) of every document."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_copies),
    ("decontamination", benchmark_free),
    ("bpe", tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
