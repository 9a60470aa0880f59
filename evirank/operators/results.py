"""Results per query: protein ranking, ligand collapse, contributor filter, summary counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .candidates import PAIR, STRONGEST, method_rank
from .ranking import keep_first, order, ranked

METHODS = ("sequence", "nearest_k", "domain")


def protein_ranking(candidates: DataFrame) -> DataFrame:
    """Rank 1..n of each query's candidates by method, then evidence; ranking_source tells which kind it has."""
    optional = {"best_domain_score": "double", "best_domain_evalue": "double", "n_shared_domains": "long"}
    for name, kind in optional.items():
        if name not in candidates.columns:
            candidates = candidates.withColumn(name, F.lit(None).cast(kind))
    has_blast = F.col("bitscore").isNotNull()
    by = [method_rank().asc_nulls_first(), has_blast.desc(), *order(*STRONGEST, "-best_domain_score", "best_domain_evalue", "-n_shared_domains", "sseqid")]
    source = F.when(has_blast, "blast").when(F.col("best_domain_score").isNotNull() | F.col("best_domain_evalue").isNotNull(), "domain").otherwise("")
    return ranked(candidates, ["qseqid"], by, "protein_rank").select(
        *PAIR, "search_type", "protein_rank", source.alias("ranking_source"),
        *[F.col(c).alias(f"blast_{c}") for c in ("bitscore", "evalue", "pident", "qcov", "scov")], "best_domain_score", "best_domain_evalue", "n_shared_domains",
    )


def ligands_of(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Every candidate with every ligand of its protein."""
    return candidates.select(*PAIR, "search_type").join(known.withColumnRenamed("uniprot_id", "sseqid"), "sseqid")


def first_ligands_of(candidates: DataFrame, known: DataFrame, ligand: str = "chem_comp_id") -> DataFrame:
    """Of ``ligands_of`` the first row of each protein and ligand by method, query and source: each ligand's first row by method,
    query, protein and source is among them.  Both sides are reduced before they meet."""
    first = keep_first(candidates.select(*PAIR, "search_type"), ["sseqid"], [method_rank().asc(), *order("qseqid")])
    return ligands_of(first, known.groupBy("uniprot_id", ligand).agg(F.min("source").alias("source")))


def with_protein_rank(ligands: DataFrame, ranking: DataFrame) -> DataFrame:
    """protein_rank of each row; a protein without one stands behind all others."""
    last = ranking.groupBy("qseqid").agg(F.max("protein_rank").alias("__n"))
    rows = ligands.join(ranking.select(*PAIR, F.col("protein_rank").alias("__r")), PAIR, "left").join(last, "qseqid", "left")
    return rows.withColumn("protein_rank", F.coalesce("__r", F.col("__n") + 1, F.lit(1))).drop("__r", "__n")


def collapse_ligands(ligands: DataFrame, ranking: DataFrame, ligand: str = "chem_comp_id", tie: list[str] = ()) -> DataFrame:
    """Per query and ligand the row of the best-ranked protein, then method, then ``tie``."""
    by = [F.asc("protein_rank"), method_rank().asc(), *order(*tie)]
    return keep_first(with_protein_rank(ligands, ranking), ["qseqid", ligand], by)


def contributors(ranking: DataFrame, *ligand_tables: DataFrame) -> DataFrame:
    """The ranked proteins that some ligand table names, ranked anew without gaps."""
    named = None
    for t in ligand_tables:
        pairs = t.select(*PAIR)
        named = pairs if named is None else named.union(pairs)
    kept = ranking.join(named, PAIR, "left_semi").withColumnRenamed("protein_rank", "__old")
    return ranked(kept, ["qseqid"], [F.asc("__old")], "protein_rank").drop("__old")


def summary(queries: DataFrame, ranking: DataFrame, known: DataFrame, predicted: DataFrame, ligand: str = "chem_comp_id") -> DataFrame:
    """Nine distinct counts per query, zeros where it has nothing; a repeated query id has repeated rows.
    Each table is reduced by itself before the joins."""

    def counts(df: DataFrame, column: str, what: str) -> DataFrame:
        return df.groupBy("qseqid").agg(*[F.countDistinct(F.when(F.col("search_type") == m, F.col(column))).alias(f"n_{what}_{m}") for m in METHODS])

    out = queries.select("qseqid")
    for df, column, what in ((ranking, "sseqid", "proteins"), (known, ligand, "known_ligands"), (predicted, ligand, "predicted_ligands")):
        out = out.join(counts(df, column, what), "qseqid", "left")
    return out.na.fill(0)


SUMMARY = T.StructType().add("qseqid", "string")
for _what in ("proteins", "known_ligands", "predicted_ligands"):
    for _m in METHODS:
        SUMMARY = SUMMARY.add(f"n_{_what}_{_m}", "long")
