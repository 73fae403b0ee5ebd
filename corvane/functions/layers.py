"""Projections in layers: later ones use the columns of earlier ones, so that nothing is written or computed twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from .dialect import CHECK, SPARK, Spark

Layer = Callable[[Spark], dict[str, str]]


def apply(df: DataFrame, layers: Sequence[Layer], keep: Sequence[str] | None = None) -> DataFrame:
    """df with the layers' columns; keep: the columns to return."""
    for layer in layers:
        new = layer(SPARK)
        df = df.selectExpr(*[f"`{c}`" for c in df.columns if c not in new], *[f"{e} AS {n}" for n, e in new.items()])
    return df.select(*keep) if keep else df


def check_sql(source: str, layers: Sequence[Layer], keep: Sequence[str] | None = None) -> str:
    """The same projection over source, a table or a subquery in parentheses, for the checking engine."""
    for i, layer in enumerate(layers):
        new = layer(CHECK)
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in new.items())} FROM {source} AS l{i})"
    return f"SELECT {', '.join(keep) if keep else '*'} FROM {source} AS result"
