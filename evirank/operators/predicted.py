"""Predicted ligands of proteins: seeds from their known ligands, similarity search, compound data, public rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import keep_first, order, top_n
from .selection import representatives
from .similarity import similarity_search


def seeds_of(known: DataFrame, vectors: DataFrame) -> DataFrame:
    """uniprot_id, query_id, value, words, bitcount: every known ligand of a protein that has a vector, once, with
    its highest pchembl (null if it has none).  known: uniprot_id, chem_comp_id, pchembl.  vectors: chem_comp_id,
    words, bitcount, one row per compound."""
    rows = known.where("uniprot_id is not null and chem_comp_id is not null").groupBy("uniprot_id", "chem_comp_id").agg(F.max("pchembl").cast("double").alias("value"))
    return rows.join(vectors.select("chem_comp_id", "words", "bitcount"), "chem_comp_id").select("uniprot_id", F.col("chem_comp_id").alias("query_id"), "value", "words", "bitcount")


def representative_seeds(seeds: DataFrame, threshold: float = 0.8, limit: int = 50) -> DataFrame:
    """Of a protein's seeds those that stand for a cluster: leader clusters up to ``limit`` seeds, MaxMin beyond,
    each represented by its member of the highest value.  Seeds are taken in the order of query_id."""
    rows = seeds.select("uniprot_id", F.col("query_id").alias("id"), F.col("query_id").alias("ord"), "words", "bitcount", "value")
    chosen = representatives(rows, "uniprot_id", "policy", threshold, limit).where("is_rep").select("uniprot_id", F.col("id").alias("query_id"))
    return seeds.join(chosen, ["uniprot_id", "query_id"], "left_semi")


def with_compounds(hits: DataFrame, compounds: DataFrame) -> DataFrame:
    """Hits with the id and structure of their target; a target without a row keeps nulls.
    compounds: lig_idx, chem_comp_id, smiles."""
    data = compounds.select(F.col("lig_idx").alias("__lig"), "chem_comp_id", "smiles")
    return hits.join(data, F.col("target_id") == F.col("__lig"), "left").drop("__lig")


def public_rows(hits: DataFrame, prefix: str = "", score: str = "tanimoto", keep: int | None = None) -> DataFrame:
    """uniprot_id, chem_comp_id, smiles, query_id, score: a protein's compound (id and structure) once, by its best
    hit; then the best ``keep`` of each protein.  hits: uniprot_id, target_id, query_id, chem_comp_id, smiles, score."""
    named = hits.withColumn("chem_comp_id", F.concat(F.lit(prefix), F.col("chem_comp_id").cast("string")))
    once = keep_first(named, ["uniprot_id", "chem_comp_id", "smiles"], order(f"-{score}", "query_id", "target_id"))
    best = top_n(once, ["uniprot_id"], order(f"-{score}", "query_id", "chem_comp_id", "smiles"), keep)
    return best.select("uniprot_id", "chem_comp_id", "smiles", "query_id", score)


def predicted_ligands(
    seeds: DataFrame, targets: DataFrame, compounds: DataFrame, threshold: float, maximum: float | None = None, top: int | None = 10_000, keep: int | None = None, prefix: str = ""
) -> DataFrame:
    """The compounds like one of a protein's seeds, for all proteins in one plan: a seed that proteins share is
    searched once.  seeds: see ``seeds_of``.  targets: target_id, words, bitcount.  ``top`` limits a protein's hits
    before, ``keep`` its compounds after these are made distinct."""
    return public_rows(with_compounds(similarity_search(seeds, targets, threshold, maximum, top=top), compounds), prefix, keep=keep)
