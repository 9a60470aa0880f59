"""Curation and merging of association data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialize
from .ranking import keep_first
from .similarity import tanimoto_join

# Comments that count as evidence against an association.
INACTIVE_COMMENTS = ("inactive", "not active", "no activity", "inconclusive inactive")


def positive_evidence(pchembl: str = "pchembl", comment: str = "activity_comment", threshold: float = 6.0):
    c = F.col(pchembl)
    return (c >= threshold) | (c.isNull() & (F.lower(comment) == "active"))


def negative_evidence(pchembl: str = "pchembl", comment: str = "activity_comment", threshold: float = 6.0):
    return (F.col(pchembl) < threshold) | F.lower(F.coalesce(comment, F.lit(""))).isin(*INACTIVE_COMMENTS)


def split_by_domains(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(curated, possible): pairs of protein and ligand with exactly one domain, and those with several."""
    counts = relations.groupBy("uniprot_id", "chem_comp_id").agg(F.countDistinct("pfam_id").alias("n_domains"))
    both = relations.join(counts, ["uniprot_id", "chem_comp_id"])
    return both.where("n_domains = 1").drop("n_domains"), both.where("n_domains > 1").drop("n_domains")


def canonical_ids(structures: DataFrame, key: str) -> DataFrame:
    """chem_comp_id, canonical_id: of the ids that share a structure key those of source 'pdb' come first, then
    the smallest.  A group is only reduced with min, so a key of any size is fine."""
    rows = structures.where(F.col(key).isNotNull())
    best = rows.groupBy(key).agg(F.min(F.struct((F.col("source") != "pdb").alias("late"), "chem_comp_id")).alias("b"))
    return rows.join(best.select(key, F.col("b.chem_comp_id").alias("canonical_id")), key).select("chem_comp_id", "canonical_id").distinct()


def remap(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations with canonical ids; an id without one stays."""
    m = mapping.select(F.col("chem_comp_id").alias("__from"), F.col("canonical_id").alias("__to"))
    return relations.join(m, F.col("chem_comp_id") == F.col("__from"), "left").withColumn("chem_comp_id", F.coalesce("__to", "chem_comp_id")).drop("__from", "__to")


def assign_ranges(residues: DataFrame, ranges: DataFrame, keys: list[str], position: str, start: str, end: str, width: int | None = None) -> DataFrame:
    """Every residue with each range on its keys that holds its position (both ends inclusive); without one it
    stays, the range's columns null.  Null keys match each other; null positions and bounds match nothing.

    Positions are cut into bins of ``width`` (the mean length of a range, if none is given), ranges stand in each bin that
    they touch, and rows meet on keys and bin: an equi-join whose groups stay small on a key with many rows and ranges.
    A pair meets in the bin of the position only, and ranges take at most twice their number of rows on average.
    """
    whole = ranges.where(F.col(start) <= F.col(end))
    if width is None:
        mean = whole.agg(F.avg(F.col(end) - F.col(start) + 1)).first()[0]
        width = max(1, round(float(mean or 1)))
    bin_of = lambda c: F.floor(c / width).cast("long")
    others = [c for c in ranges.columns if c not in keys]
    right = whole.select(*[F.col(k).alias(f"__{k}") for k in keys], *others, F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))).alias("__range_bin"))
    on = (F.col("__bin") == F.col("__range_bin")) & F.col(position).between(F.col(start), F.col(end))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return residues.withColumn("__bin", bin_of(F.col(position))).join(right, on, "left").drop(*[f"__{k}" for k in keys], "__bin", "__range_bin")


def deny(relations: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Relations whose value is not on the list."""
    return relations.join(listed.select(F.col(listed.columns[0]).alias("__no")).distinct(), F.col(column) == F.col("__no"), "left_anti")


def similarity_curation(possible: DataFrame, trusted: DataFrame, threshold: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(curated, remaining) of the possible relations.

    Curated: relations for whose domain some trusted ligand has a Tanimoto of at least the threshold.
    Remaining: those whose pair of ligand and protein has no curated row.  possible: uniprot_id,
    chem_comp_id, pfam_id, words, bitcount.  trusted: pfam_id, words, bitcount.

    Distinct ligands meet the distinct vectors of their domain; each brings its best one only (``tanimoto_join``).
    """
    ligand = possible.select("pfam_id", "chem_comp_id", "words", "bitcount").dropDuplicates(["pfam_id", "chem_comp_id"])
    a = ligand.where("chem_comp_id is not null").select("pfam_id", F.struct("pfam_id", "chem_comp_id").alias("query_id"), "words", "bitcount")
    b = trusted.select("pfam_id", F.lit(0).alias("target_id"), "words", "bitcount").distinct()
    supported = tanimoto_join(a, b, threshold, per_query=1, within=["pfam_id"]).select("query_id.*")
    curated = possible.join(supported, ["pfam_id", "chem_comp_id"], "left_semi")
    remaining = possible.join(curated.select("uniprot_id", "chem_comp_id"), ["uniprot_id", "chem_comp_id"], "left_anti")
    return curated, remaining


def incremental_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, each row once."""
    return old.unionByName(new, allowMissingColumns=True).distinct()


def unseen(ids: DataFrame, seen: DataFrame, column: str) -> DataFrame:
    return ids.join(seen.select(column), column, "left_anti")


def normalize_compounds(table: DataFrame, id_column: str, structure_column: str, ord_column: str) -> DataFrame:
    """chem_comp_id, smiles, lig_idx: trimmed, blanks left out, the first row of an id kept, numbered 0.. in
    row order.  The number needs one order over all rows; Spark range-sorts them and counts per partition."""
    rows = table.select(F.trim(F.col(id_column).cast("string")).alias("chem_comp_id"), F.trim(F.col(structure_column).cast("string")).alias("smiles"), F.col(ord_column).alias("ord"))
    rows = keep_first(rows.where("chem_comp_id <> '' and smiles <> ''"), ["chem_comp_id"], [F.asc("ord")])
    return dense_index(rows, ["ord", "chem_comp_id"], "lig_idx").select("chem_comp_id", "smiles", "lig_idx")


def dense_index(rows: DataFrame, by: list[str], into: str) -> DataFrame:
    """0..n-1 over all rows in a total order, without one task that holds them all: range partitions are
    numbered inside, and shifted by the sizes of those before them (one row per partition)."""
    parts = materialize(rows.repartitionByRange(*by).withColumn("__p", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*by)) - 1)
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.drop("__n")), "__p").withColumn(into, F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")
