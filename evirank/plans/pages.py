"""Filtered, sorted, paged views of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import method_rank
from ..operators.ranking import keep_first, order


def filtered(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Equality filters; 'all' and empty values, and columns that the table lacks, filter nothing."""
    for name, value in filters.items():
        if value and value != "all" and name in df.columns:
            df = df.where(F.col(name).cast("string") == str(value))
    return df


def page(df: DataFrame, number: int = 1, size: int = 50, filters: dict[str, str | None] | None = None, sort_by: str | None = None, descending: bool = False, tie: list[str] = ()) -> DataFrame:
    """One page of rows, nulls last; ``tie`` makes the order total.  Spark reads as far as the page's end only."""
    rows = filtered(df, filters or {})
    by = [f"-{sort_by}" if descending else sort_by] if sort_by in df.columns else []
    if by or tie:
        rows = rows.orderBy(*order(*by, *tie))
    return rows.offset((max(1, number) - 1) * size).limit(size)


def total_pages(df: DataFrame, size: int, filters: dict[str, str | None] | None = None) -> DataFrame:
    """total, total_pages (at least 1)."""
    return filtered(df, filters or {}).agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def counts_by_method(df: DataFrame) -> DataFrame:
    return df.groupBy("search_type").agg(F.count("*").alias("n"))


def sources_by_method(df: DataFrame) -> DataFrame:
    """search_type, sources: the distinct sources of its rows, sorted; null is none."""
    return df.groupBy("search_type").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def best_per_compound(df: DataFrame, ligand: str, tie: list[str]) -> DataFrame:
    """The first row of each compound, but one of a better method before it."""
    return keep_first(df, [ligand], [method_rank().asc(), *order(*tie)])


def totals(summary: DataFrame) -> DataFrame:
    """Sums of all counters over the queries."""
    return summary.agg(F.count("*").alias("n_queries"), *[F.sum(c).alias(c) for c in summary.columns if c != "qseqid"])
