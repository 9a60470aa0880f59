"""From raw documents to a training mix: toxicity, line dedup, near-dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evirank.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from evirank.llm.common import broadcast_if_small, materialize, quoted, table
from evirank.llm.queries import training_labels


def _row(docs: DataFrame) -> Column:
    """All columns as one, so that no name clashes with an operator's."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.  The classifier learns from labelled rows outside the held-out fold.

    Each row is scored by its own text: null, empty and very long texts, null and repeated doc_ids and repeated
    rows each keep or lose their own row.  An empty table gives an empty result.  Columns of any name are kept
    as they are.
    """
    model = toxicity.train(docs, training_labels(spark, sf_dir))
    others = [c for c in docs.columns if c != "text"]
    # the text comes back from the worker beside the row, not in it too: half the memory
    kept = toxicity.score(docs, model, [F.struct(*[F.col(quoted(c)) for c in others]).alias("__row")], text=True).where("predicted = 0")
    text = F.col("text").cast(docs.schema["text"].dataType)
    return kept.select(*[(text if c == "text" else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents share stay in the largest doc_id only; n_chars follows the text.

    Every row stays.  Null and empty texts stay as they are; rows that repeat a doc_id count as one document,
    rows without a doc_id as one that is below all others.  An empty table gives an empty result.  Columns of any
    name are kept as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    found = line_dedup.dedup_lines(docs, keep=[F.struct(*[F.col(quoted(c)) for c in others]).alias("__row")])
    new = {"text": F.col("text")}
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("__row.n_chars"))
    return found.select(*[new.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) one document stays: that of
    the smallest doc_id, null ids last, and of equal ids one text.

    Documents are told apart by doc_id and text, so a text that is like no other stays whatever its doc_id, null and
    repeated ids too.  Rows that repeat the document that stays go but for one.  Null, empty and blank texts are copies
    of each other.  An empty table gives an empty result.  Columns of any name are kept as they are.
    """
    found = materialize(simhash.similar_texts(docs, shingle=5, similarity=0.8), "near-copies")
    rows = docs.select(_row(docs), F.col("doc_id").alias("__id"), simhash.text_hash().alias("__text"))
    same = lambda ids: F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__text") == F.col("text_hash"))
    gone = found.where("not stays").select("doc_id", "text_hash")
    kept = rows.join(broadcast_if_small(gone), same(gone), "left_anti")
    again = found.where("stays and n_rows > 1").select("doc_id", "text_hash")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        one = kept.join(again, same(again), "left_semi").dropDuplicates(["__id", "__text"])
        kept = kept.join(again, same(again), "left_anti").union(one)
    return kept.select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go.

    Each row is judged by its own text, whatever its doc_id; null and empty texts stay.  An empty table gives an empty
    result.  Columns of any name are kept as they are.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, taken and the source's size and target: how many words of each document the mix takes.

    One result row per row; null texts have size 0 and nothing is taken of them; null sources are a source; other
    columns are ignored; an empty table gives an empty result."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: No stage but the line dedup has a SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
