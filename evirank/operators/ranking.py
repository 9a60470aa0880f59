"""Deterministic ranking: every order is total, nulls stand last, and only row_number semantics exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def order(*spec: str) -> list[Column]:
    """'name' ascending or '-name' descending, nulls last either way."""
    return [F.desc_nulls_last(s[1:]) if s.startswith("-") else F.asc_nulls_last(s) for s in spec]


def ranked(df: DataFrame, keys: list[str], by: list[Column], into: str) -> DataFrame:
    """1..n within each group of ``keys``."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


def top_n(df: DataFrame, keys: list[str], by: list[Column], n: int | None) -> DataFrame:
    """The first n rows of each group; None keeps all, n <= 0 none.  Catalyst turns the filter into a
    partial and final group limit, so a large group never travels whole."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    return ranked(df, keys, by, "__rank").where(F.col("__rank") <= n).drop("__rank")


def keep_first(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per group, the first in the given order."""
    return top_n(df, keys, by, 1)
