"""Known associations: collapse source rows per domain, then per protein, ligand and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ligands with a structure that are sent to the binding rows.
FEW_LIGANDS = 500_000
KEYS = ["uniprot_id", "chem_comp_id", "pfam_id", "source"]


def _first(value: str, by: str) -> Column:
    """The first non-null value in row order."""
    return F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(by)))


def _ordered_distinct(pairs: Column) -> Column:
    """Values of (ord, value) structs in order, first occurrence of each."""
    return F.array_distinct(F.transform(F.array_sort(pairs), lambda x: x["v"]))


TEXTS = ["mechanism", "activity_comment", "curation_method"]


def collapse_by_domain(binding: DataFrame) -> DataFrame:
    """Per protein, ligand, domain and source: ids in row order (column ord), maximum, first non-null texts.
    Rows with a null key are left out."""
    keys = KEYS
    texts = [c for c in TEXTS if c in binding.columns]
    some = F.when(F.col("pdb_id").isNotNull(), F.struct(F.col("ord"), F.col("pdb_id").alias("v")))
    return binding.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(
        _ordered_distinct(F.collect_list(some)).alias("pdb_ids"), F.max("pchembl").alias("pchembl"), *[_first(c, "ord").alias(c) for c in texts]
    )


def collapse_sites(per_domain: DataFrame) -> DataFrame:
    """Per protein, ligand and source: sorted domains, merged ids, maximum, first non-null texts, domains in
    sorted order."""
    texts = [c for c in TEXTS if c in per_domain.columns]
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pfam_id", "pdb_ids"))), lambda x: x["pdb_ids"])
    return per_domain.groupBy("uniprot_id", "chem_comp_id", "source").agg(
        F.sort_array(F.collect_set("pfam_id")).alias("binding_sites"), F.array_distinct(F.flatten(lists)).alias("pdb_ids"),
        F.max("pchembl").alias("pchembl"), *[_first(c, "pfam_id").alias(c) for c in texts],
    )


def known_binding(binding: DataFrame, structures: DataFrame) -> DataFrame:
    """The collapsed table with each ligand's structure; ligands without one are left out.
    structures: chem_comp_id, smiles (of several the smallest counts)."""
    lookup = structures.where("chem_comp_id is not null and smiles is not null").groupBy("chem_comp_id").agg(F.min("smiles").alias("smiles"))
    return collapse_sites(collapse_by_domain(binding)).join(lookup, "chem_comp_id")


def known_rows(binding: DataFrame, structures: DataFrame) -> DataFrame:
    """uniprot_id, chem_comp_id, source of the rows that ``known_binding`` collapses, repeated: for results that need no more of
    it, so that they are reduced before any shuffle."""
    named = structures.where("chem_comp_id is not null and smiles is not null").select("chem_comp_id").distinct()
    few = F.broadcast(named) if named.limit(FEW_LIGANDS + 1).count() <= FEW_LIGANDS else named
    rows = binding.where(" and ".join(f"{k} is not null" for k in KEYS))
    return rows.select("uniprot_id", "chem_comp_id", "source").join(few, "chem_comp_id", "left_semi")


def protein_domains(binding: DataFrame) -> DataFrame:
    return binding.where("uniprot_id is not null and pfam_id is not null").select("uniprot_id", "pfam_id").distinct()
