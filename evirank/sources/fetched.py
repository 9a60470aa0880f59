"""Answers of structure services, fetched beforehand: one JSON document per compound, some broken, some without a structure.

Nothing is dropped unseen: every asked id has a status, and a ledger says which are to be fetched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
# The part of an answer that has the structure, and its fields, the first that is not blank counts.
DESCRIPTOR, STRUCTURES = "rcsb_chem_comp_descriptor", ("smiles", "smiles_stereo", "smiles_canonical")
ANSWER = T.StructType().add(DESCRIPTOR, T.StructType([T.StructField(n, T.StringType()) for n in STRUCTURES])).add(CORRUPT, "string")
#: Times that an id is asked for.
ATTEMPTS = 3


def _id(column: Column) -> Column:
    return F.nullif(F.upper(F.trim(column.cast("string"))), F.lit(""))


def _status(answer: Column) -> list[Column]:
    found = F.coalesce(*[F.nullif(F.trim(answer[DESCRIPTOR][n]), F.lit("")) for n in STRUCTURES])
    status = F.when(answer[CORRUPT].isNotNull() | answer.isNull(), "broken").when(found.isNull(), "empty").otherwise("ok")
    return [F.when(status == "ok", found).alias("smiles"), status.alias("status"), F.when(status == "broken", answer[CORRUPT]).alias("raw")]


def _best(rows: DataFrame) -> DataFrame:
    """One row per id: an answer with a structure before an empty before a broken one, then the smallest structure."""
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "empty", 1).otherwise(2)
    best = rows.where("chem_comp_id is not null").groupBy("chem_comp_id").agg(F.min(F.struct(rank.alias("rank"), "smiles", "status", "raw")).alias("b"))
    return best.select("chem_comp_id", "b.smiles", "b.status", "b.raw")


def parse_answers(answers: DataFrame) -> DataFrame:
    """chem_comp_id (trimmed, upper case), smiles, status ('ok', 'empty', 'broken') and raw (a broken answer's text), one row
    per id.  answers: chem_comp_id, body (JSON); a null body is broken."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = answers.select(_id(F.col("chem_comp_id")).alias("chem_comp_id"), F.from_json("body", ANSWER, options).alias("a"))
    return _best(parsed.select("chem_comp_id", *_status(F.col("a"))))


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The same of a folder of files named after their compound, ``<id>.json``."""
    files = spark.read.schema(ANSWER).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", "*.json").json(folder)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    rows = files.select(_id(F.url_decode(name)).alias("chem_comp_id"), F.struct(DESCRIPTOR, CORRUPT).alias("a"))
    return _best(rows.select("chem_comp_id", *_status(F.col("a"))))


def wanted(ligands: DataFrame) -> DataFrame:
    """The distinct ids of a table's chem_comp_id, in upper case; blanks are none."""
    return ligands.select(_id(F.col("chem_comp_id")).alias("chem_comp_id")).where("chem_comp_id is not null").distinct()


def structure_table(ligands: DataFrame, structures: DataFrame, answers: DataFrame) -> DataFrame:
    """chem_comp_id, smiles, source ('pdb') of every asked ligand that has a structure: from the table of structures, else
    from the answers.  structures: chem_comp_id, smiles, one row per id.  answers: see ``parse_answers``."""
    held = structures.where("smiles is not null").select("chem_comp_id", F.col("smiles").alias("__held"))
    fetched = answers.where("status = 'ok'").select("chem_comp_id", F.col("smiles").alias("__fetched"))
    rows = wanted(ligands).join(held, "chem_comp_id", "left").join(fetched, "chem_comp_id", "left")
    return rows.select("chem_comp_id", F.coalesce("__held", "__fetched").alias("smiles"), F.lit("pdb").alias("source")).where("smiles is not null")


def to_fetch(ligands: DataFrame, structures: DataFrame, ledger: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """chem_comp_id of the ligands to ask for: without a structure in the table, not answered with one, and asked fewer than
    ``attempts`` times.  An empty answer is final; a broken or absent one is asked for again."""
    over = ledger.where(F.col("status").isin("ok", "empty") | (F.col("attempts") >= attempts))
    return wanted(ligands).join(structures.where("smiles is not null"), "chem_comp_id", "left_anti").join(over, "chem_comp_id", "left_anti")


def record(ledger: DataFrame, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The ledger after a round: chem_comp_id, status ('ok', 'empty', 'broken' or 'absent') and attempts.  asked: the ids of
    the round; those without an answer are absent.  Answers that nobody asked for do not count."""
    now = asked.select("chem_comp_id").distinct().join(answers.select("chem_comp_id", F.col("status").alias("__now")), "chem_comp_id", "left")
    now = now.withColumn("__now", F.coalesce("__now", F.lit("absent")))
    both = ledger.join(now, "chem_comp_id", "full")
    return both.select("chem_comp_id", F.coalesce("__now", "status").alias("status"), (F.coalesce("attempts", F.lit(0)) + F.col("__now").isNotNull().cast("int")).alias("attempts"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "chem_comp_id string, status string, attempts int")
