"""Readers: sequence files, search-tool tables, compound tables, binding sites.  All read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import first_token, strip_version

# Column names that hold a compound's id or structure, first match wins, any case.
ID_COLUMNS = ("chem_comp_id", "compound", "compound_id", "id")
STRUCTURE_COLUMNS = ("smiles", "canonical_smiles")


def file_order() -> Column:
    """The place of a row in its files: path, start of the block, then the order inside the block.  To be selected where
    files are read; however they are split, rows sort as they stand in them.  (The running number alone follows Spark's
    packing of blocks into tasks; inside one block it only grows.)"""
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def fasta_queries(lines: DataFrame) -> DataFrame:
    """qseqid of each header line of a table of lines (column value), repeats kept, headers without a word left out."""
    return lines.where(F.startswith("value", F.lit(">"))).select(first_token(F.col("value")).alias("qseqid")).where("qseqid is not null")


def fasta_ids(lines: DataFrame) -> DataFrame:
    """The distinct qseqid of a table of lines."""
    return fasta_queries(lines).distinct()


def read_fasta_queries(spark: SparkSession, path: str) -> DataFrame:
    return fasta_queries(spark.read.text(path))


def fasta_details(lines: DataFrame) -> DataFrame:
    """One row: valid, n_records, n_residues, and the ids that repeat (sorted)."""
    header = F.startswith("value", F.lit(">"))
    residues = F.when(~header, F.length(F.regexp_replace("value", r"\s", ""))).otherwise(0)
    totals = lines.agg(F.count(F.when(header, 1)).alias("n_records"), F.coalesce(F.sum(residues), F.lit(0)).cast("long").alias("n_residues"))
    twice = fasta_queries(lines).groupBy("qseqid").count().where("count > 1").agg(F.sort_array(F.collect_list("qseqid")).alias("repeated"))
    return totals.join(twice, how="full").withColumn("valid", (F.col("n_records") > 0) & (F.col("n_residues") > 0))


def read_fasta_sequences(spark: SparkSession, path: str) -> DataFrame:
    """accession, sequence, one row per accession (of several the last in the file): the part between bars of
    sp|ACC|.. and tr|ACC|.. headers, else the first word.  A '>' begins a record only at the start of a line."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"), file_order().alias("ord")).where(F.trim("value") != "")
    head, body = F.element_at(F.split("value", "\n", 2), 1), F.element_at(F.split("value", "\n", 2), 2)
    bars = F.regexp_extract(head, r"^(?:sp|tr)\|([^|]*)\|", 1)
    rows = records.select(F.when(bars != "", bars).otherwise(first_token(head)).alias("accession"), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", "").alias("sequence"), "ord")
    return rows.where("accession is not null").groupBy("accession").agg(F.max_by("sequence", "ord").alias("sequence"))


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schemas.BLAST_HITS)


def read_hmmer(spark: SparkSession, path: str) -> DataFrame:
    """Domain tables: blank and # lines skipped, 22 typed fields, the description ignored; pfam_id has no version."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= len(schemas.HMMER_HITS))
    columns = [F.col("p")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.HMMER_HITS)]
    return parts.select(*columns).withColumn("pfam_id", strip_version(F.col("pfam_acc")))


def format_of(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    kinds = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "smi": "smi", "parquet": "parquet"}
    if suffix not in kinds:
        raise ValueError(f"unknown format of {path!r}")
    return kinds[suffix]


def read_compounds(spark: SparkSession, path: str, kind: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A table of compounds; .smi lines are 'structure id ..'.  Column ord has the order of the rows in the files."""
    kind = kind or format_of(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "smi":
        parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), file_order().alias("ord")).where(F.size("p") >= 2)
        return parts.select(F.col("p")[0].alias("smiles"), F.col("p")[1].alias("chem_comp_id"), "ord")
    elif kind in ("csv", "tsv"):
        df = spark.read.csv(path, header=True, sep=delimiter or ("," if kind == "csv" else "\t"))
    else:
        raise ValueError(f"unknown format {kind!r}")
    return df.select("*", file_order().alias("ord"))


def pick_column(columns: list[str], aliases: tuple[str, ...], what: str) -> str:
    """The column whose name, in any case, stands earliest among ``aliases``; of several such the leftmost."""
    rank = {alias.lower(): place for place, alias in enumerate(aliases)}
    known = [(rank[c.lower()], at, c) for at, c in enumerate(columns) if c.lower() in rank]
    if not known:
        raise ValueError(f"no {what} column in {columns}")
    return min(known)[2]


def read_smi_folder(spark: SparkSession, folder: str) -> DataFrame:
    """smiles, chem_comp_id, path, ord of all .smi files below a folder; ord is the order of the files and their lines."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.smi").text(folder)
    parts = lines.select(F.split(F.trim("value"), r"\s+").alias("p"), F.col("_metadata.file_path").alias("path"), file_order().alias("ord"))
    return parts.where(F.size("p") >= 2).select(F.col("p")[0].alias("smiles"), F.col("p")[1].alias("chem_comp_id"), "path", "ord")


def read_pfam_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Domain ranges on chains; rows without numeric bounds are left out."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#")
    out = df.select(
        F.lower(F.trim("PDB")).alias("pdb_id"), F.trim("CHAIN").alias("chain"), F.trim("PFAM_ACCESSION").alias("pfam_id"),
        F.col("AUTH_PDBRES_START").try_cast("int").alias("range_start"), F.col("AUTH_PDBRES_END").try_cast("int").alias("range_end"),
    )
    return out.where("range_start is not null and range_end is not null")


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """chem_comp_id (upper case), smiles from a headerless table of structure and id; the first row of an id.
    '#' is a bond in structures, so only lines that begin with it are comments."""
    df = spark.read.csv(path, sep="\t", comment="#", schema=T.StructType().add("smiles", "string").add("chem_comp_id", "string"))
    rows = df.select("*", file_order().alias("ord")).withColumn("chem_comp_id", F.upper(F.trim("chem_comp_id"))).where("chem_comp_id <> '' and smiles is not null")
    return rows.groupBy("chem_comp_id").agg(F.min_by("smiles", "ord").alias("smiles"))


def binding_residues(sites: DataFrame) -> DataFrame:
    """One row per site, ligand residue and site residue.  sites: pdb_id, sites (array of structs); names that
    some releases of the data use instead are taken where the usual ones are null."""
    site = sites.select("pdb_id", F.explode("sites").alias("s"))
    have = {f.name for f in sites.schema["sites"].dataType.elementType}

    def field(x: str, fields: set[str], *names: str):
        found = [F.col(f"{x}.{n}").cast("string") for n in names if n in fields]
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in found]) if found else F.lit(None).cast("string")

    inner = lambda name: {f.name for f in sites.schema["sites"].dataType.elementType[name].dataType.elementType}
    ligand = site.select("pdb_id", field("s", have, "site_id", "site_number").alias("site_id"), field("s", have, "description", "site_type").alias("site_label"), "s.site_residues", F.explode("s.ligand_residues").alias("l"))
    both = ligand.select("pdb_id", "site_id", "site_label", "l", F.explode("site_residues").alias("r"))
    lf, rf = inner("ligand_residues"), inner("site_residues")
    return both.select(
        "pdb_id", "site_id", "site_label", field("l", lf, "chem_comp_id", "residue_name").alias("chem_comp_id"), field("l", lf, "chain_id", "author_chain_id").alias("ligand_chain_id"),
        field("l", lf, "author_residue_number", "residue_number").try_cast("int").alias("ligand_res_seq"), field("r", rf, "chain_id", "author_chain_id").alias("residue_chain_id"),
        field("r", rf, "author_residue_number", "residue_number").try_cast("int").alias("residue_number"), field("r", rf, "residue_name").alias("residue_name"),
    )


def read_binding_sites(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType().add("pdb_id", "string").add("sites", T.ArrayType(schemas.BINDING_SITES))
    return binding_residues(spark.read.schema(schema).json(path))


def read_sqlite(spark: SparkSession, url: str, query: str) -> DataFrame:
    """A query of a relational store by JDBC; its driver must be on Spark's class path."""
    return spark.read.format("jdbc").option("url", url).option("query", query).load()
