"""Tables that are looked up by key: hash buckets as a partition column, so that asked keys prune the files.

The number of buckets is part of the column's name (``bucket_of_256``), so a stored table says how it is to be read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "bucket_of_"
#: Asked keys that are broadcast, so that Spark prunes while it runs; beyond them their buckets, at most ``buckets``
#: numbers, are named in the scan.
BROADCAST_KEYS = 100_000


def bucket(key: Column, buckets: int) -> Column:
    """A null key is in bucket 0."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), F.lit(0))


def write_lookup(df: DataFrame, path: str, key: str, buckets: int = 256, mode: str = "overwrite") -> None:
    """Parquet with a folder per bucket of ``key``, sorted by it.  Buckets are rebalanced, so one that a frequent key makes
    large becomes several files and tasks."""
    name = f"{PREFIX}{buckets}"
    rows = df.withColumn(name, bucket(F.col(key), buckets))
    rows.hint("rebalance", F.col(name)).sortWithinPartitions(name, key).write.mode(mode).partitionBy(name).parquet(path)


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a table of ``write_lookup`` whose ``key`` is among ``ids`` (first column; repeats and nulls do not
    count).  Only files of the asked keys' buckets are read."""
    table = spark.read.parquet(path)
    name = next(c for c in table.columns if re.fullmatch(PREFIX + r"\d+", c))
    buckets = int(name.removeprefix(PREFIX))
    asked = ids.select(F.col(ids.columns[0]).cast(table.schema[key].dataType).alias("__key")).where("__key is not null").distinct()
    asked = asked.withColumn("__bucket", bucket(F.col("__key"), buckets))
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        # the filter holds for all; Spark prunes by a side that has one
        asked = F.broadcast(asked.where(F.col("__bucket") >= 0))
    else:
        table = table.where(F.col(name).isin([r[0] for r in asked.select("__bucket").distinct().collect()]))
    return table.join(asked, (F.col(key) == F.col("__key")) & (F.col(name) == F.col("__bucket")), "left_semi").drop(name)
