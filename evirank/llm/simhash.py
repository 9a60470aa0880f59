"""SimHash near-dedup with a byte-position inverted index and count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, bytes_of, materialize, text_hash
from .components import components
from .near_copies import near_copies, verified

__all__ = ["fingerprint", "fingerprints", "links", "near_duplicates", "position_sets", "similar_links", "similar_texts", "text_hash"]


def fingerprint(text: bytes | None, shingle: int, words: int = 1, seed: int = 42) -> list[int]:
    """``words`` fingerprints of 64 bits.  A bit is 1 if over half the shingles' hashes have it; no words:
    zero.  The first fingerprint's hash is XXH64; the others remix it, as independent hash functions."""
    split = (text or b"").translate(LOWER).split()
    if not split:
        return [0] * words
    line = b" ".join(split)
    n = max(1, len(split) - shingle + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
        starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h, out = np.array(hashes, np.uint64), []
    for w in range(words):
        if w:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
            h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fps: the fingerprints' 64 bits as signed longs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            fps = np.array([fingerprint(t, shingle, words) for t in bytes_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(fps), pa.list_(pa.int64()))], ["doc_id", "fps"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fps array<long>")


def position_sets(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any two fingerprints within ``max_bits`` share at least one whole.

    Such a pair differs in at most ``max_bits`` of 8 bytes, so at least 8 - max_bits positional bytes match:
    the count that the filter demands.  For 3 bits the 14 planes of the affine space of 8 points suffice,
    four positions each (every three points lie in a plane, so some plane's complement, itself a plane,
    avoids any three differing bytes); otherwise all sets of that many positions, four at most.
    """
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: beyond, no byte need match")
    if max_bits == 3:
        return [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]
    return list(combinations(range(8), min(4, 8 - max_bits)))


def _links(max_bits: int, sets: int):
    def forest(fps: np.ndarray) -> list[tuple[int, int]]:
        """Links that span the components of one posting list.  Each fingerprint is met once: it tallies
        the positional bytes it shares with those not reached yet, keeps the ones with the guaranteed
        minimum of matches and verifies their bits.  Memory is linear in the list."""
        out, left = [], fps
        while len(left) > 1:
            wave, left = left[:1], left[1:]
            while len(wave) and len(left):
                x, wave = wave[0], wave[1:]
                diff = left ^ x
                tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
                near = tally >= 8 - max_bits
                near[near] = np.bitwise_count(diff[near]) <= max_bits
                if near.any():
                    got = left[near]
                    out += [(int(x.view(np.int64)), int(y)) for y in got.view(np.int64)]
                    wave, left = np.concatenate((wave, got)), left[~near]
        return out

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by posting key: whole posting lists, carried over batch ends."""
        key, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        group = np.zeros(0, np.int64)

        def flush(k: np.ndarray, g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]))))
            size = np.diff(np.append(first, len(k)))
            src, dst, at = [], [], []
            two = first[size == 2]
            near = np.bitwise_count((f[two] ^ f[two + 1]).view(np.uint64)) <= max_bits
            src += f[two[near]].tolist()
            dst += f[two[near] + 1].tolist()
            at += (g[two[near]] // sets).tolist()
            for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                for a, b in forest(f[i : i + n].view(np.uint64)):
                    src.append(a)
                    dst.append(b)
                    at.append(int(g[i]) // sets)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, src, dst)], ["w", "src", "dst"])

        for b in batches(rows):
            g, k, f = (np.concatenate((x, np.asarray(b.column(i)))) for i, x in enumerate((group, key, fps)))
            cut = int(np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]))))[-1])
            if cut:
                yield flush(k[:cut], g[:cut], f[:cut])
            group, key, fps = g[cut:], k[cut:], f[cut:]
        if len(key):
            yield flush(key, group, fps)

    return run


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(w, src, dst) between distinct fingerprints (columns w, which of a text's, and fp): a spanning forest
    of every posting list, so all of them together connect just what the pairs within ``max_bits`` differing
    bits connect.

    A posting's key is a set of positions with the bytes there.  A list is read as sorted rows of distinct
    fingerprints; it never becomes pairs, in its task or beyond.
    """
    sets = position_sets(max_bits)
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    postings = F.explode(F.array(*[F.struct((F.col("w") * len(sets) + g).cast("long").alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for g, m in enumerate(signed)]))
    keyed = fps.select(postings.alias("p"), "fp").select("p.g", "p.key", "fp")
    return keyed.repartition("g", "key").sortWithinPartitions("g", "key", "fp").mapInArrow(_links(max_bits, len(sets)), "w long, src long, dst long")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fps, component_id: the smallest doc_id reachable over texts that have one of their ``words``
    fingerprints within ``max_bits`` bits.

    More fingerprints find pairs of lower similarity: one of 64 bits within 3 finds few below 0.95.  One
    row per input row.  Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle
    are one shingle; null, empty and blank texts have fingerprint zero and link like any other.  Repeated
    rows link to each other.  A null doc_id takes part, but a component's id is its smallest non-null
    doc_id (null if there is none).  Empty table: empty result; other columns are ignored.

    Equal fingerprints are collapsed first (a group that holds a third of all rows is one row per map
    task), the index holds distinct fingerprints only, and components run over a spanning forest.
    """
    rows = materialize(fingerprints(docs, shingle, words), "fingerprints")
    node = F.col("fps")[0] if words == 1 else F.xxhash64("fps")
    classes = materialize(rows.groupBy("fps").agg(F.min("doc_id").alias("least")).withColumn("node", node), "classes")
    each = classes.select("node", F.posexplode("fps").alias("w", "fp"))
    own = materialize(each.groupBy("w", "fp").agg(F.min("node").alias("rep")), "postings")
    found = links(own.select("w", "fp"), max_bits).distinct()
    if words == 1:
        edges = found.select("src", "dst")
    else:  # from fingerprints to the texts that have them
        at = lambda side: own.select(F.col("w").alias(f"w_{side}"), F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}"))
        far = (
            found.withColumnRenamed("src", "s").withColumnRenamed("dst", "d")
            .join(at("src"), (F.col("w") == F.col("w_src")) & (F.col("s") == F.col("src")))
            .join(at("dst"), (F.col("w") == F.col("w_dst")) & (F.col("d") == F.col("dst")))
            .select(F.col("rep_src").alias("src"), F.col("rep_dst").alias("dst"))
        )
        same = each.join(own, ["w", "fp"]).where("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
        edges = far.union(same)
    roots = components(edges)
    member = classes.select("node", "least").join(roots, "node")
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    linked = member.join(least, "root").select(F.col("node").alias("l_node"), "component")
    ids = classes.join(linked, F.col("node") == F.col("l_node"), "left").select(F.col("fps").alias("c_fps"), F.coalesce("component", "least").alias("component_id"))
    return rows.join(ids, F.col("fps") == F.col("c_fps")).select("doc_id", "fps", "component_id")


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """(src, dst) hashes of different texts whose fingerprints are linked within ``max_bits`` bits (``links``) and whose
    shingle sets have the similarity: each text with the first of its fingerprint, and those along the links."""
    texts = docs.select(text_hash().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    of = materialize(fingerprints(texts, shingle).select(F.col("doc_id").alias("node"), F.col("fps")[0].alias("fp")).distinct(), "fingerprints")
    own = materialize(of.groupBy("fp").agg(F.min("node").alias("rep")), "postings")
    at = lambda side: own.select(F.col("fp").alias(f"fp_{side}"), F.col("rep").alias(side))
    found = links(own.select(F.lit(0).cast("long").alias("w"), "fp"), max_bits).select(F.col("src").alias("fp_src"), F.col("dst").alias("fp_dst")).distinct()
    pairs = found.join(at("src"), "fp_src").join(at("dst"), "fp_dst").select("src", "dst")
    same = of.join(own, "fp").where("node <> rep").select(F.col("node").alias("src"), F.col("rep").alias("dst"))
    return materialize(verified(materialize(pairs.union(same), "pairs"), docs, shingle, similarity), "verified")


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, component_id, stays, n_rows: near copies down to a Jaccard similarity of the word shingles,
    one row per distinct (doc_id, text).

    The fingerprints' index links the copies within 3 bits (``similar_links``).  Below a similarity of some 0.95 it finds
    few: at 0.8 a byte of sign bits agrees with probability 0.27 only, and no affordable number of them finds most such
    pairs.  So the rest comes from the same index of positions with a count filter over bytes of min-hashes.  Every link is
    verified on the shingle sets.  See ``near_copies``.
    """
    return near_copies(docs, shingle, similarity, similar_links(docs, shingle, similarity))
