"""Filter interaction audit: what each filter removes in every order of the filters.

The orders form a trie of prefixes.  It is walked depth-first: a filter is applied to the persisted survivors of the
prefix before it, and the survivors are counted by part.  What survives depends only on which filters were applied, not
on their order, so each unordered prefix is visited once and its counts serve all orders: 2**n states for n filters.
At most n survivor tables are persisted at a time; the counts of a state are written before its survivors go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialize, scratch_path

#: Parts whose counts one file holds.
PARTS_A_FILE = 200_000
#: Filters at most: 2**n states are walked, n! orders returned.
MOST_FILTERS = 6

_UPPER = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    """When a text fails: under ``words`` words; under ``distinct`` percent distinct words; over ``upper`` percent
    capital letters A-Z; any of the letters ``special``."""

    words: int = 50
    distinct: int = 65
    upper: int = 5
    special: bytes = b"#$%&*|"


def text_flags(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, part (the source, null as the empty string), digest (SHA-256 of the text) and whether the text fails A
    (few words), B (repeated words), C (capitals), D (special letters).  Null texts count as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            digests, flags = [], ([], [], [], [])
            for raw in b.column(2).cast(pa.large_binary()).to_pylist():
                words = raw.split()  # at the same bytes as [\x20\x09-\x0D]+
                points = len(raw.translate(None, _CONTINUED))
                fails = (
                    len(words) < limits.words, 100 * len(set(words)) < limits.distinct * len(words),
                    100 * (len(raw) - len(raw.translate(None, _UPPER))) > limits.upper * points, len(raw.translate(None, limits.special)) < len(raw),
                )
                digests.append(hashlib.sha256(raw).digest())
                for column, fail in zip(flags, fails, strict=True):
                    column.append(fail)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), *(pa.array(f, pa.bool_()) for f in flags)], ["doc_id", "part", "digest", *"ABCD"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, digest binary, A boolean, B boolean, C boolean, D boolean")


def with_copies(flags: DataFrame) -> DataFrame:
    """The rows with E: the same text stands under a smaller doc_id, anywhere in the table.  A row without a doc_id is
    neither above nor below another.  Texts are told apart by their SHA-256; only those that occur twice are joined, from a
    written table, so that Spark can split the rows of a text with very many copies."""
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col("digest").alias("__digest"), "__first")
    firsts = materialize(firsts, "copies")
    joined = flags.join(firsts, F.col("digest") == F.col("__digest"), "left")
    return joined.withColumn("E", F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))).drop("__digest", "__first", "digest")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good (quality 1) and toxic (toxic 1); of several labels of a doc_id any counts, without one neither."""
    known = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("__good"), F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    joined = rows.join(known, F.col("doc_id") == F.col("__id"), "left")
    return joined.withColumn("good", F.coalesce(F.col("__good") == 1, F.lit(False))).withColumn("toxic", F.coalesce(F.col("__toxic") == 1, F.lit(False))).drop("__id", "__good", "__toxic")


def edge_counts(rows: DataFrame, filters: list[str]) -> DataFrame:
    """part, state, filter, left, removed, good_lost, toxic_lost: of the survivors of each set of filters (state: their
    bits), how many there are and what a further filter removes.

    rows: part, good, toxic and a boolean column for each filter (true: the row fails it, null: it does not).  Parts
    without survivors are left out of a state."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    spark = rows.sparkSession
    files = 1 + rows.select("part").distinct().count() // PARTS_A_FILE
    path = scratch_path(spark, "audit")
    seen: set[int] = set()

    def count(survivors: DataFrame, state: int) -> None:
        later = [(i, f) for i, f in enumerate(filters) if not state >> i & 1]
        fails = {f: F.col(f) for _, f in later}
        sums = [F.count_if(c).alias(f"n{f}") for f, c in fails.items()] + [F.count_if(c & F.col(x)).alias(f"{x}{f}") for f, c in fails.items() for x in ("good", "toxic")]
        by_part = survivors.groupBy("part").agg(F.count("*").alias("left"), *sums).coalesce(files)
        edges = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"n{f}").alias("removed"), F.col(f"good{f}").alias("good_lost"), F.col(f"toxic{f}").alias("toxic_lost")) for f in fails]))
        by_part.select("part", F.lit(state).alias("state"), "left", edges.alias("e")).select("part", "state", "left", "e.*").write.mode("append").parquet(path)

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        count(survivors, state)
        for i, f in enumerate(filters):
            after = state | 1 << i
            if after == state or after in seen or after == (1 << len(filters)) - 1:
                continue  # applied already, known from another order, or nothing left to apply
            kept = survivors.where(~F.coalesce(F.col(f), F.lit(False))).persist(StorageLevel.MEMORY_AND_DISK)
            visit(kept, after)
            kept.unpersist()

    start = rows.select("part", "good", "toxic", *filters).persist(StorageLevel.MEMORY_AND_DISK)
    visit(start, 0)
    start.unpersist()
    return spark.read.parquet(path)


def by_order(edges: DataFrame, filters: list[str]) -> DataFrame:
    """The edges laid out by part, filter_order and step; zeros included.  The n! orders are a small table that goes to
    the counts of the states, of which there are some dozens a part."""
    spark, n = edges.sparkSession, len(filters)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[j] for j in order), step, state, filters[i]))
            state |= 1 << i
    trie = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, __state int, __filter string"))
    weight = reduce(lambda c, k: c.when(F.bit_count("state") == k, factorial(k) * factorial(n - 1 - k)), range(n), F.when(F.lit(False), F.lit(0)))
    last = F.bit_count("state") == n - 1
    totals = edges.groupBy(F.col("part").alias("__part"), F.col("filter").alias("__of")).agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("__failing"), F.coalesce(F.sum(F.when(last, F.col("removed"))), F.lit(0)).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"),
    )
    measured = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("left", "removed", "good_lost", "toxic_lost")]
    laid = totals.join(trie, F.col("__of") == F.col("__filter")).join(edges, (F.col("__part") == F.col("part")) & (F.col("__state") == F.col("state")) & (F.col("__filter") == F.col("filter")), "left")
    rows = laid.select(F.col("__part").alias("part"), "filter_order", "step", "__failing", "unique_fails", "shapley", *measured)
    kept, redundant = F.col("left") - F.col("removed"), F.col("__failing") - F.col("removed")
    return rows.select("part", "filter_order", "step", kept.alias("kept"), "removed", redundant.alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per part (source), order of the filters A to E and step: kept, removed, redundant (failing the step's filter
    but removed earlier), unique_fails (failing no other filter), good_lost and toxic_lost (removed here, by label), and
    shapley (removed by the step's filter, summed over all orders).

    Null texts count as empty, null sources as the empty string; repeated rows count each, and so do equal texts: all but
    those of the smallest doc_id fail E, rows without a doc_id do not.  Very long texts are read whole.  Other columns may
    have any name.  An empty table gives an empty result.
    """
    rows = with_labels(with_copies(materialize(text_flags(docs, limits), "flags")), labels)
    return by_order(edge_counts(materialize(rows.drop("doc_id"), "audited"), list("ABCDE")), list("ABCDE"))
