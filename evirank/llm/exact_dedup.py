"""Exact dedup by a Golomb-coded fingerprint exchange."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bytes_of, materialize, rows_with, text_hash


def golomb_encode(values: np.ndarray, span_bits: int) -> tuple[int, bytes]:
    """Rice-code (Golomb with a power of two) the gaps of a sorted array of unsigned integers below
    2**span_bits; returns the parameter and the bytes.  Gap = q * 2**k + r: q ones, a zero, then r in k bits."""
    n = len(values)
    if not n:
        return 0, b""
    k = max(0, span_bits - max(1, n).bit_length())
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1 + k)
    bits = np.zeros(int(ends[-1]), np.uint8)
    first = ends - (q + 1 + k)
    unary = np.repeat(first, q) + (np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q))
    bits[unary] = 1
    for j in range(k):
        bits[ends - k + j] = (gaps >> np.uint64(k - 1 - j)) & np.uint64(1)
    return k, np.packbits(bits).tobytes()


def golomb_decode(k: int, data: bytes, n: int) -> np.ndarray:
    """Inverse of ``golomb_encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    flat, at = bits.tobytes(), 0
    ends = np.empty(n, np.int64)
    for i in range(n):  # a gap's unary part ends at the first zero from where the last gap ended
        ends[i] = end = flat.find(0, at)
        at = end + 1 + k
    starts = np.concatenate(([0], ends[:-1] + 1 + k))
    out = (ends - starts).astype(np.uint64) << np.uint64(k)
    for j in range(k):
        out |= bits[ends + 1 + j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(out, dtype=np.uint64)


def fingerprints(docs: DataFrame, owner_bits: int) -> DataFrame:
    """One pass over the texts.  Rows of kind 'doc' (block, doc_id, fp, text_sha256) and of kind 'sent'
    (block, owner, n, k, blob): a block's distinct fingerprints of one owner, sorted and compressed."""
    shift = np.uint64(64 - owner_bits)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for b in batches(rows):
            block = uuid.uuid4().hex  # one task attempt's output is kept, so a block is whole and unique
            ids = b.column(0)
            fp = np.asarray(b.column(2)).view(np.uint64)
            sha = [hashlib.sha256(t or b"").hexdigest() for t in bytes_of(b.column(1))]
            n = len(fp)
            yield out(["doc"] * n, [block] * n, ids, fp.view(np.int64), sha, [None] * n, [None] * n, [None] * n, [None] * n)
            distinct = np.unique(fp)
            owner = (distinct >> shift).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
            rest = distinct & ((np.uint64(1) << shift) - np.uint64(1)) if owner_bits else distinct
            own, first, count = np.unique(owner, return_index=True, return_counts=True)
            coded = [golomb_encode(rest[i : i + c], int(shift)) for i, c in zip(first, count, strict=True)]
            m = len(own)
            none = [None] * m
            yield out(["sent"] * m, [block] * m, pa.nulls(m, ids.type), none, none, own, count, [k for k, _ in coded], [d for _, d in coded])

    schema = docs.select("doc_id").schema
    spec = f"kind string, block string, doc_id {schema[0].dataType.simpleString()}, fp long, text_sha256 string, owner long, n long, k int, blob binary"

    def out(kind, block, ids, fp, sha, owner, n, k, blob) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(kind, pa.string()), pa.array(block, pa.string()), ids, pa.array(fp, pa.int64()), pa.array(sha, pa.string()),
                pa.array(owner, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(blob, pa.binary()),
            ],
            ["kind", "block", "doc_id", "fp", "text_sha256", "owner", "n", "k", "blob"],
        )

    return docs.select("doc_id", F.col("text").cast("string"), text_hash()).mapInArrow(run, spec)


def _bitmaps(keys: tuple, sent: pa.Table) -> pa.Table:
    """An owner's side of the exchange: which of its fingerprints came from more than one block."""
    columns = sent.to_pydict()
    got = [golomb_decode(k, d, n) for k, d, n in zip(columns["k"], columns["blob"], columns["n"], strict=True)]
    values, counts = np.unique(np.concatenate(got), return_counts=True)
    twice = values[counts > 1]
    maps = [np.packbits(np.isin(x, twice, assume_unique=True)).tobytes() for x in got]
    return pa.table({"block": pa.array(columns["block"], pa.string()), "owner": pa.array(columns["owner"], pa.int64()), "bitmap": pa.array(maps, pa.binary())})


def _suspects(owner_bits: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        """A block's rows whose fingerprint repeats inside the block or is marked in an owner's bitmap."""
        fp = np.asarray(docs["fp"]).view(np.uint64) if docs.num_rows else np.zeros(0, np.uint64)
        distinct, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
        twice = counts > 1
        owner = (distinct >> np.uint64(64 - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(distinct), np.int64)
        first, last = {}, {}
        own, at, n = np.unique(owner, return_index=True, return_counts=True)
        for o, i, m in zip(own.tolist(), at.tolist(), n.tolist(), strict=True):
            first[o], last[o] = i, i + m
        for o, bits in zip(back["owner"].to_pylist(), back["bitmap"].to_pylist(), strict=True):
            m = last[o] - first[o]
            twice[first[o] : last[o]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
        return pa.table({"doc_id": docs["doc_id"], "text_sha256": docs["text_sha256"], "fp": docs["fp"], "suspect": pa.array(twice[inverse] if len(fp) else [], pa.bool_())})

    return run


def exact_dedup(docs: DataFrame, owner_bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when their bytes are; null counts as empty.  Of equal texts the largest doc_id stays
    (null ids are smallest; of repeated rows with that id, all are marked kept since they are one
    document).  An empty table gives an empty result; other columns are ignored.

    1. Each block of rows sends its owners their sorted, Rice-coded distinct 64-bit fingerprints.
    2. Owners answer with one bit per fingerprint: seen in another block too.
    3. Only suspects' texts are shuffled, and grouped by their full bytes with map-side combine, so a
       group that holds a third of all rows is one row per map task.  Up to ``BROADCAST_KEYS`` suspect
       fingerprints are sent to the texts; only beyond that do all texts meet them in a shuffle.
    4. Groups are linked back by SHA-256, or by the bytes where two texts should share one.

    owner_bits: 2**owner_bits owners; by default one per 2 million rows, at least 16.
    """
    spark = docs.sparkSession
    if owner_bits is None:
        owner_bits = max(4, (docs.select("doc_id").count() // 2_000_000).bit_length())
    pass1 = materialize(fingerprints(docs, owner_bits), "fingerprints")
    id_type = pass1.schema["doc_id"].dataType.simpleString()
    back = pass1.where("kind = 'sent'").select("block", "owner", "n", "k", "blob").groupBy("owner").applyInArrow(_bitmaps, "block string, owner long, bitmap binary")
    rows = pass1.where("kind = 'doc'").select("block", "doc_id", "fp", "text_sha256")
    marked = materialize(
        rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_suspects(owner_bits), f"doc_id {id_type}, text_sha256 string, fp long, suspect boolean"),
        "suspects",
    )
    suspects = marked.where("suspect").select("fp").distinct()
    texts = rows_with(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_hash().alias("fp")), "fp", suspects)
    groups = materialize(
        texts.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.sha2("text", 256).alias("g_sha"), "keep_id", "group_size", "text")
        .withColumn("text", F.when(F.col("group_size") > 1, F.col("text"))).where("group_size > 1"),
        "groups",
    )
    clash = groups.groupBy("g_sha").count().where("count > 1").limit(1).count()
    if clash:  # two texts with one SHA-256: link those rows by their bytes
        full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
        linked = full.join(groups, full.t == groups.text, "left").withColumn("text_sha256", F.sha2("t", 256))
    else:
        linked = marked.join(groups.drop("text"), F.col("text_sha256") == F.col("g_sha"), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return linked.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )
