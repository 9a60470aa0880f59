"""Schemas of the tables that readers produce and operators take."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    out = T.StructType()
    for part in spec.split(","):
        name, kind = part.split()
        out.add(name, {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "long": T.LongType()}[kind])
    return out


# The column order of the two search tools' tabular outputs.
BLAST_HITS = _schema(
    "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, "
    "sstart int, send int, evalue double, bitscore double, qlen int, slen int"
)
HMMER_HITS = _schema(
    "target_name string, pfam_acc string, tlen int, qseqid string, qacc string, qlen int, full_evalue double, "
    "full_score double, full_bias double, dom_index int, dom_of int, dom_c_evalue double, dom_i_evalue double, "
    "dom_score double, dom_bias double, hmm_from int, hmm_to int, ali_from int, ali_to int, env_from int, env_to int, acc double"
)
PFAM_RANGES = _schema("pdb_id string, chain string, pfam_id string, range_start int, range_end int")
BINDING_SITES = T.StructType().add("site_id", "string").add("site_label", "string").add(
    "ligand_residues",
    T.ArrayType(T.StructType().add("chem_comp_id", "string").add("chain_id", "string").add("author_residue_number", "integer")),
).add(
    "site_residues",
    T.ArrayType(T.StructType().add("chem_comp_id", "string").add("chain_id", "string").add("author_residue_number", "integer")),
)
