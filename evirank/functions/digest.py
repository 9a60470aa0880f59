"""A digest of a table's rows that follows neither their order nor their partitions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _hashable(df: DataFrame, field: T.StructField) -> Column:
    """Maps cannot be hashed: their entries, sorted by their JSON, can."""
    name = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, T.MapType):
        return F.array_sort(F.transform(F.map_entries(name), lambda e: F.to_json(e)))
    if "map<" in field.dataType.simpleString():
        return F.to_json(name)
    return name


def row_sums(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """n_rows and two sums of 64-bit row hashes, per ``keys`` or of the whole table.

    A row's hash takes its values with their columns' names, in the order of the names, so the order of columns does not
    count; a null differs from every value.  The sums are decimals of 38 digits and do not overflow.  The second sum
    hashes the rows with a salt, so tables that differ agree in both with a probability of about 2**-128."""
    names = sorted(c for c in df.columns)
    fields = {f.name: f for f in df.schema}
    values = [x for n in names for x in (F.lit(n), F.col("`" + n.replace("`", "``") + "`").isNull(), _hashable(df, fields[n]))]
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("decimal(38,0)")
    out = [F.count(F.lit(1)).alias("n_rows"), total(F.xxhash64(*values)).alias("sum_1"), total(F.xxhash64(F.lit("salt"), *values)).alias("sum_2")]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def table_fingerprint(df: DataFrame) -> str:
    """SHA-256 over the columns' names and types, the number of rows and the sums of their hashes.  The same table gives
    the same digest however it is stored, sorted or partitioned; one changed cell, a row more or a row twice another.
    One pass, partial sums in the tasks, one row to the driver."""
    n, a, b = row_sums(df).first()
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
    return hashlib.sha256(json.dumps([schema, n, str(a), str(b)]).encode()).hexdigest()


def database_fingerprint(tables: dict[str, DataFrame], **settings: object) -> str:
    """One digest for several tables and settings, by name."""
    payload = {"settings": settings, "tables": {name: table_fingerprint(df) for name, df in tables.items()}}
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
