"""Positions and running sums in a global order without one window over all rows: two levels, over slices of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, key: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """df with `out`: the sum of value over rows of smaller key (a unique bigint). Windows hold `width` keys, or the slices."""
    sliced = df.withColumn("__s", F.floor(F.col(key) / width))
    inner = sliced.withColumn("__i", F.sum(value).over(Window.partitionBy("__s").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)))
    totals = sliced.groupBy("__s").agg(F.sum(value).alias("__t"))
    before = totals.select("__s", F.sum("__t").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    return inner.join(before, "__s").withColumn(out, F.coalesce("__i", F.lit(0)) + F.coalesce("__b", F.lit(0))).drop("__s", "__i", "__b")


def positions(df: DataFrame, key: str, out: str = "position", width: int = 1 << 16) -> DataFrame:
    """df with `out`: the row's 0-based place in order of key, a unique bigint."""
    return running(df.withColumn("__1", F.lit(1).cast("bigint")), key, "__1", out, width).drop("__1")
