"""Builds of the association tables: activity relations, structure relations, their merge, sequence upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import curation

RELATION = ["chem_comp_id", "uniprot_id", "pfam_id", "pchembl", "mechanism"]


def activity_relations(activities: DataFrame, mechanisms: DataFrame, source: str = "chembl", threshold: float = 6.0) -> DataFrame:
    """RELATION, activity_comment, source, kind ('curated' or 'possible').

    Relations with positive evidence, with their pair's mechanism if it has one, and the mechanisms of pairs without
    such evidence.  Rows equal in RELATION (nulls equal) are one, with the smallest comment.  A pair with one domain
    is curated, with several possible.  activities: chem_comp_id, uniprot_id, pfam_id, pchembl, activity_comment.
    mechanisms: chem_comp_id, uniprot_id, pfam_id, mechanism.
    """
    pair = ["chem_comp_id", "uniprot_id"]
    by_pair = mechanisms.select(*pair, "mechanism").distinct()
    positive = activities.where(curation.positive_evidence(threshold=threshold))
    proven = positive.join(by_pair, pair, "left").select(*RELATION, "activity_comment")
    alone = mechanisms.join(positive.select(*pair), pair, "left_anti")
    none = {"pchembl": F.lit(None).cast(proven.schema["pchembl"].dataType), "activity_comment": F.lit(None).cast("string")}
    rows = proven.unionByName(alone.withColumns(none).select(*RELATION, "activity_comment"))
    rows = rows.groupBy(*RELATION).agg(F.min("activity_comment").alias("activity_comment")).withColumn("source", F.lit(source))
    curated, possible = curation.split_by_domains(rows)
    return curated.withColumn("kind", F.lit("curated")).unionByName(possible.withColumn("kind", F.lit("possible")))


def structure_relations(residues: DataFrame, ranges: DataFrame, accessions: DataFrame, denied: DataFrame, structures: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """pdb_id, chem_comp_id, pfam_id, uniprot_id, each once: ligands by the domain that holds a residue they touch.

    Entries in ``seen`` (pdb_id) and ligands on the list ``denied`` (chem_comp_id) are left out, so are ligands without
    a structure and residues in no domain.  An entry without an accession keeps null.  residues: pdb_id, chain_id,
    residue_number, chem_comp_id.  ranges: pdb_id, chain_id, range_start, range_end, pfam_id.  accessions: pdb_id,
    uniprot_id.  structures: chem_comp_id.
    """
    if seen is not None:
        residues = curation.unseen(residues, seen, "pdb_id")
    touched = curation.deny(residues.where("chem_comp_id is not null"), "chem_comp_id", denied.select("chem_comp_id"))
    touched = touched.join(structures.select("chem_comp_id"), "chem_comp_id", "left_semi")
    held = curation.assign_ranges(touched, ranges, ["pdb_id", "chain_id"], "residue_number", "range_start", "range_end")
    found = held.where("pfam_id is not null").select("pdb_id", "chem_comp_id", "pfam_id").distinct()
    return found.join(accessions.select("pdb_id", "uniprot_id").distinct(), "pdb_id", "left").select("pdb_id", "chem_comp_id", "pfam_id", "uniprot_id")


def merge_relations(structure: DataFrame, curated: DataFrame, possible: DataFrame, mapping: DataFrame, vectors: DataFrame, threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(merged, remaining).  Ids of the activity tables become canonical; possible relations that a ligand of the
    structure table supports for their domain join the curated ones; merged is these and the structure table.
    Tables: uniprot_id, chem_comp_id, pfam_id and columns of their own.  vectors: chem_comp_id, words, bitcount; a
    ligand without a vector supports nothing and stays possible."""
    look = vectors.select("chem_comp_id", "words", "bitcount")
    moved = curation.remap(possible, mapping).join(look, "chem_comp_id", "left")
    trusted = structure.select("pfam_id", "chem_comp_id").distinct().join(look, "chem_comp_id").select("pfam_id", "words", "bitcount")
    supported, remaining = (part.drop("words", "bitcount") for part in curation.similarity_curation(moved, trusted, threshold))
    activity = curation.remap(curated, mapping).unionByName(supported, allowMissingColumns=True)
    return structure.unionByName(activity, allowMissingColumns=True), remaining


def ligands_by_domain(relations: DataFrame) -> DataFrame:
    """pfam_id, ligands: the distinct ligands of each domain, sorted."""
    return relations.where("pfam_id is not null and chem_comp_id is not null").groupBy("pfam_id").agg(F.sort_array(F.collect_set("chem_comp_id")).alias("ligands"))


def sequence_changes(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """accession, change ('new' or 'obsolete'): wanted accessions that are not held, and held ones no longer wanted.
    Blank accessions are none; spaces around them do not count."""
    clean = wanted.select(F.trim("accession").alias("accession")).where("accession <> '' and lower(accession) <> 'nan'").distinct()
    new = clean.join(held.select("accession"), "accession", "left_anti").withColumn("change", F.lit("new"))
    return new.unionByName(held.select("accession").distinct().join(clean, "accession", "left_anti").withColumn("change", F.lit("obsolete")))


def sync_sequences(held: DataFrame, wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    """accession, sequence: held sequences without the obsolete ones, and of the fetched those that are new.  A new
    accession that was not fetched is missing and comes up again at the next sync."""
    changes = sequence_changes(held, wanted)
    kept = held.join(changes.where("change = 'obsolete'"), "accession", "left_anti").select("accession", "sequence")
    new = fetched.join(changes.where("change = 'new'"), "accession", "left_semi").groupBy("accession").agg(F.min("sequence").alias("sequence"))
    return kept.unionByName(new)
