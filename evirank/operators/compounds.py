"""Compound bases: featurisers as plug-ins, and the representation table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialize
from ..sources.writers import publish, published
from .curation import normalize_compounds
from .similarity import bitcount

Featurizer = Callable[[pd.Series], np.ndarray]


def hashed_ngrams(n_bits: int = 1024, sizes: tuple[int, ...] = (2, 3, 4)) -> Featurizer:
    """A stand-in that needs no chemistry library: bits of hashed character n-grams.  It is deterministic and lets
    everything downstream run; it is not a chemical fingerprint.  Null or empty structures give no bits."""

    def run(structures: pd.Series) -> np.ndarray:
        out = np.zeros((len(structures), n_bits), np.uint8)
        for i, s in enumerate(structures):
            for n in sizes:
                for j in range(len(s or "") - n + 1):
                    out[i, int.from_bytes(hashlib.blake2b(s[j : j + n].encode(), digest_size=4).digest(), "little") % n_bits] = 1
        return out

    return run


def representation(ligands: DataFrame, featurize: Featurizer, n_bits: int) -> DataFrame:
    """lig_idx, words, bitcount, failed of ligands (lig_idx, smiles).  The featurizer maps a batch of structures
    to rows of 0 and 1; a row of zeros counts as failed."""
    width = -(-n_bits // 64) * 64

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            bits = np.zeros((len(pdf), width), np.uint8)
            bits[:, :n_bits] = featurize(pdf["smiles"])
            words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield pd.DataFrame({"lig_idx": pdf["lig_idx"], "words": list(words)})

    schema = T.StructType().add("lig_idx", "long").add("words", T.ArrayType(T.LongType()))
    rows = ligands.select("lig_idx", "smiles").mapInPandas(run, schema).withColumn("bitcount", bitcount(F.col("words")))
    return rows.withColumn("failed", F.col("bitcount") == 0)


def gather(vectors: DataFrame, asked: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """position, key and the vectors' columns for each asked row (position, key), repeats too; order by position to have
    them as they were asked.  An asked key without a vector is an error, or left out if not ``strict``.  vectors: key and
    others, one row per key."""
    rows = asked.select("position", F.col(key).alias("__asked")).join(vectors, F.col("__asked") == F.col(key), "left" if strict else "inner")
    if not strict:
        return rows.drop("__asked")
    absent = F.raise_error(F.concat(F.lit(f"no vector of {key} "), F.coalesce(F.col("__asked").cast("string"), F.lit("null"))))
    return rows.withColumn(key, F.when(F.col(key).isNull(), absent.cast(vectors.schema[key].dataType)).otherwise(F.col(key))).drop("__asked")


def build_base(table: DataFrame, id_column: str, structure_column: str, ord_column: str, featurizers: dict[str, tuple[Featurizer, int]], path: str) -> None:
    """Build a compound base from a table of any size: its ligands (chem_comp_id, smiles, lig_idx) and a representation for
    each named featurizer and its number of bits.  All are published as one version, so indexes always belong together, and
    a build that fails leaves the base before it."""
    ligands = materialize(normalize_compounds(table, id_column, structure_column, ord_column), "ligands")
    publish({"ligands": ligands} | {f"representations/{name}": representation(ligands, featurize, n_bits) for name, (featurize, n_bits) in featurizers.items()}, path)


def open_base(spark: SparkSession, path: str, name: str) -> DataFrame:
    """chem_comp_id, smiles, lig_idx, words, bitcount, failed of a built base and one of its representations."""
    return published(spark, path, "ligands").join(published(spark, path, f"representations/{name}"), "lig_idx")


def failures(rows: DataFrame) -> DataFrame:
    """n, n_failed, share of a representation."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("n_failed"), F.avg(F.col("failed").cast("int")).alias("share"))
