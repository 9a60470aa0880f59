"""Writers: result tables per query, one summary file, sequences, versions of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import Folder


def write_per_query(df: DataFrame, path: str) -> None:
    """A folder of TSV files per query; queries without rows have none."""
    df.repartition("qseqid").write.mode("overwrite").partitionBy("qseqid").csv(path, sep="\t", header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """One TSV file in the order of the queries; one row per query, so it stays small."""
    df.orderBy("qseqid").coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_clustered(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Parquet whose files hold ranges of the key, so that footer statistics prune lookups by it."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def fasta_records(df: DataFrame, width: int = 60) -> DataFrame:
    """value: FASTA records of (accession, sequence), lines wrapped; null sequences are left out."""
    wrapped = F.regexp_replace(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return df.where("sequence is not null").select(F.concat(F.lit(">"), "accession", F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    fasta_records(df, width).write.mode("overwrite").text(path)


def write_results(ranking: DataFrame, known: DataFrame, predicted: DataFrame, path: str) -> None:
    """The three tables of every query, each with a folder per query; a query without known or predicted ligands has
    no folder in those tables."""
    for name, rows in (("protein_ranking", ranking), ("known_ligands", known), ("predicted_ligands", predicted)):
        write_per_query(rows, f"{path}/{name}")


def publish(tables: DataFrame | dict[str, DataFrame], path: str) -> str:
    """Write a table, or several that belong together by name, as a new version below ``path`` and make it the current one;
    returns the version.

    The rows are staged under a name of their own and renamed when all are whole; then the pointer CURRENT is replaced.
    A write that fails leaves the version before it in place, and readers never see a part of it."""
    parts = tables if isinstance(tables, dict) else {"": tables}
    folder, version = Folder(next(iter(parts.values())).sparkSession, path), f"v-{uuid.uuid4().hex}"
    try:
        for name, df in parts.items():
            df.write.parquet(folder.at(f".staging-{version}/{name}".rstrip("/")))
        folder.move(f".staging-{version}", version)
    except Exception:
        folder.delete(f".staging-{version}")
        raise
    folder.write("CURRENT", {"version": version})
    return version


def published(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """The current version of what ``publish`` wrote; of several tables the named one."""
    now = Folder(spark, path).read("CURRENT")
    if now is None:
        raise ValueError(f"nothing is published below {path}")
    return spark.read.parquet(f"{path}/{now['version']}/{name}".rstrip("/"))


def drop_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Remove all versions but the current one, and what failed writes left; returns their names."""
    folder = Folder(spark, path)
    now = (folder.read("CURRENT") or {}).get("version")
    old = [n for n in folder.names() if n != now and (n.startswith("v-") or n.startswith(".staging-"))]
    for name in old:
        folder.delete(name)
    return old
