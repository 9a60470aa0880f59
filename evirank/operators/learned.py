"""Learned search: a protein's known ligands against all targets, scored by the model of its best domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .predicted import public_rows, representative_seeds, seeds_of, with_compounds
from .scoring import best_models, learned_scores


def model_seeds(domains: DataFrame, registry: DataFrame, known: DataFrame, vectors: DataFrame, limit: int | None = 10, threshold: float = 0.8) -> DataFrame:
    """uniprot_id, pfam_id, query_id, words: the seeds of each protein that has a domain with a trained model and known
    ligands with a vector, with the domain of the best model.  ``limit``: at most so many representatives of a protein's
    ligands (see ``representative_seeds``); None takes all ligands.

    domains: uniprot_id, pfam_id.  registry: pfam_id, val_pr_auc, status.  known: uniprot_id, chem_comp_id, pchembl.
    vectors: chem_comp_id, words, bitcount.
    """
    best = best_models(registry, domains.where("uniprot_id is not null and pfam_id is not null").distinct())
    seeds = seeds_of(known.join(best.select("uniprot_id"), "uniprot_id", "left_semi"), vectors)
    seeds = seeds if limit is None else representative_seeds(seeds, threshold, limit)
    return seeds.join(best, "uniprot_id").select("uniprot_id", "pfam_id", "query_id", "words")


def learned_search(
    domains: DataFrame, registry: DataFrame, models: DataFrame, known: DataFrame, vectors: DataFrame, targets: DataFrame, compounds: DataFrame, dim: int, threshold: float = 0.5, limit: int | None = 10,
    cluster: float = 0.8, per_seed: int | None = 1000, top: int | None = 10_000, prefix: str = "", **blocks: int,
) -> DataFrame:
    """uniprot_id, pfam_id, chem_comp_id, smiles, query_id, bsi_score: for every protein the compounds that the model of its
    best domain scores at least ``threshold`` against one of its seeds, each compound (id and structure) once by its best
    hit, the best ``top`` of a protein.  All proteins are searched in one plan; proteins without a domain with a model,
    or without known ligands, give nothing.  models: see ``scoring.MODEL_TABLE``.  targets: target_id, words.  compounds:
    lig_idx, chem_comp_id, smiles.  The other tables: see ``model_seeds``."""
    seeds = materialize(model_seeds(domains, registry, known, vectors, limit, cluster), "model-seeds")
    hits = learned_scores(seeds, targets, models, dim, threshold, per_seed, top=None, **blocks)
    rows = public_rows(with_compounds(hits, compounds), prefix, "bsi_score", top)
    return rows.join(seeds.select("uniprot_id", "pfam_id").distinct(), "uniprot_id").select("uniprot_id", "pfam_id", "chem_comp_id", "smiles", "query_id", F.col("bsi_score"))
