"""Which tables of a data package are there."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.files import Folder


def missing(spark: SparkSession, root: str, paths: list[str]) -> list[str]:
    """Those of the paths, relative to the root, that do not exist or are empty folders; in the given order."""
    folder = Folder(spark, root)
    there = lambda p: folder.exists(p) and (not folder.is_folder(p) or bool(Folder(spark, folder.at(p)).names()))
    return [p for p in dict.fromkeys(paths) if not there(p)]


def ready(spark: SparkSession, root: str, required: list[str], optional: dict[str, list[str]] | None = None) -> dict:
    """ready (nothing required is missing), missing, and for each optional part whether it is whole."""
    lost = missing(spark, root, required)
    return {"ready": not lost, "missing": lost, "optional": {name: not missing(spark, root, paths) for name, paths in (optional or {}).items()}}
