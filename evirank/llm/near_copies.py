"""Near copies of whole texts: a byte-position index with count filtering, verified on the shingle sets.

Fingerprints of sign bits miss most pairs near a similarity of 0.8 (a byte of eight such bits agrees with
probability 0.27), so each positional byte here comes from a min-hash of the shingle set instead and agrees
with a probability of just over the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, bytes_of, materialize, rows_with, runs, text_hash
from .components import components
from .substring_dedup import combine, hashed

#: Position sets of the index: 16 of 4 positions, 64 in all.  A pair of similarity 0.8 shares one whole with
#: probability 1 - (1 - 0.8**4)**16 > 0.9997.
BANDS, ROWS = 16, 4
#: Positional bytes of 64 that a pair must share before its sets are compared.  A pair at 0.8 shares 51 on average
#: and fewer than 44 with probability 0.01; beyond 0.8 with less.
LEAST = 44
#: Texts of a posting list that are compared in one task; a longer list is dealt into parts.
PART = 512
#: Shingles that are hashed together.
BLOCK = 200_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's word shingles.  Words are split at ASCII white space, A-Z
    lower-cased; fewer words than a shingle are one shingle; no words count as one empty shingle."""
    words = (text or b"").translate(LOWER).split()
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    h = combine(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), size)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    flat = np.concatenate(sets).astype(np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(hashed(flat, k), starts) for k in range(BANDS * ROWS)], axis=1)


def posting_keys(mins: np.ndarray) -> np.ndarray:
    """A long per position set and row."""
    return np.stack([combine(mins[:, i : i + ROWS].ravel(), ROWS)[::ROWS] for i in range(0, BANDS * ROWS, ROWS)], axis=1).view(np.int64)


def positional_bytes(mins: np.ndarray) -> np.ndarray:
    return (mins >> np.uint64(40)).astype(np.uint8)


def _blocks(texts: list[bytes | None], size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(from, to, shingle sets) of texts, about ``BLOCK`` shingles at a time."""
    start, sets, total = 0, [], 0
    for i, t in enumerate(texts):
        sets.append(shingle_set(t, size))
        total += len(sets[-1])
        if total >= BLOCK or i + 1 == len(texts):
            yield start, i + 1, sets
            start, sets, total = i + 1, [], 0


def _index(docs: DataFrame, size: int) -> DataFrame:
    """node, k0, k1, ...: the text's hash and its posting keys, a row per distinct text."""
    names = [f"k{i}" for i in range(BANDS)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for i, j, sets in _blocks(bytes_of(b.column(1)), size):
                keys = posting_keys(min_hashes(sets))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(keys[:, k]) for k in range(BANDS))], ["node", *names])

    keyed = docs.select(text_hash().alias("node"), F.col("text").cast("string")).mapInArrow(run, ", ".join(["node long", *(f"{k} long" for k in names)]))
    return keyed.groupBy("node").agg(*[F.first(k).alias(k) for k in names])


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, bytes, shingles of the texts whose hash is in ``nodes``, a row per distinct text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for i, j, sets in _blocks(bytes_of(b.column(1)), size):
                sketch = positional_bytes(min_hashes(sets))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "bytes", "shingles"]
                )

    source = docs.select(text_hash().alias("node"), F.col("text").cast("string").alias("text"))
    # one row of each text: of copies that are many, a task passes on the first one it meets
    one = rows_with(source, "node", nodes).groupBy("node").agg(F.min("text").alias("text"))
    return one.mapInArrow(run, "node long, bytes binary, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of pairs (src, dst) of text hashes those whose shingle sets have the similarity."""
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    sets = materialize(_sets(docs, nodes, size), "shingle-sets")
    side = lambda n: sets.select(F.col("node").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in sets.columns if c != "node"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            one, two = (b.column(f"{n}_shingles").to_pylist() for n in ("src", "dst"))
            ok = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(one, two, strict=True)]
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_shingles", "dst_shingles").mapInArrow(run, "src long, dst long")


def alike(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    if min(len(one), len(two)) < similarity * max(len(one), len(two)) - 1e-9:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similarity * (len(one) + len(two) - both) - 1e-9


class _Part:
    """The texts of one part of a posting list."""

    def __init__(self, slices: list[pa.RecordBatch]):
        self.node = np.concatenate([np.asarray(s.column("node")) for s in slices])
        self.label = np.concatenate([np.asarray(s.column("label")) for s in slices])
        self.bytes = np.frombuffer(b"".join(x for s in slices for x in s.column("bytes").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.sets = [np.frombuffer(x, np.uint32) for s in slices for x in s.column("shingles").to_pylist()]
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def link(self, other: _Part, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int]]:
        """Verified links (own, other's) among (shared bytes, own place, other's place) between texts that no
        link joins yet, those that share most first."""
        out = []
        order = np.argsort(-pairs[0], kind="stable")
        for i, j in zip(pairs[1][order].tolist(), pairs[2][order].tolist(), strict=True):
            a, b = self.find(int(self.label[i])), self.find(int(other.label[j]))
            if a != b and alike(self.sets[i], other.sets[j], similarity):
                self.parent[a] = b
                out.append((int(self.node[i]), int(other.node[j])))
        return out

    def near(self, other: _Part, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The count filter: pairs that share at least ``LEAST`` positional bytes."""
        shared, own, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(self.node)):
            first = i + 1 if inside else 0
            tally = (other.bytes[first:] == self.bytes[i]).sum(1)
            hit = np.flatnonzero((tally >= LEAST) & (other.label[first:] != self.label[i]))
            shared.append(tally[hit])
            own.append(np.full(len(hit), i))
            far.append(hit + first)
        return np.concatenate(shared), np.concatenate(own), np.concatenate(far)


def _links(lists: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): a verified spanning forest of each part of a posting list (key, part, visits, node, label,
    bytes, shingles).  Rows that visit are compared with the part's own and not held."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.RecordBatch] = []
        home: _Part | None = None

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

        def close() -> Iterator[pa.RecordBatch]:
            if home is None and len(own):  # no visitors: the part's own pairs
                part = _Part(own)
                yield out(part.link(part, part.near(part, True), similarity))

        for new, part in runs(rows, 2):
            if new:
                yield from close()
                own, home = [], None
            guests = part.filter(part.column("visits"))
            if home is None and guests.num_rows < part.num_rows:
                own.append(part.filter(pc.invert(part.column("visits"))))
            if guests.num_rows and own:
                home = home or _Part(own)
                # the visitors' links join the labels of the part from now on
                guest = _Part([guests])
                guest.parent = home.parent
                yield out(guest.link(home, guest.near(home, False), similarity))
        yield from close()

    ordered = lists.select("key", "part", "visits", "node", "label", "bytes", "shingles").repartition("key", "part").sortWithinPartitions("key", "part", "visits")
    return ordered.mapInArrow(run, "src long, dst long")


def text_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """(node, root): of every distinct text that is linked to another, its hash (``text_hash``) and the
    smallest hash reachable over pairs of texts whose sets of ``size``-word shingles have a Jaccard similarity
    of at least ``similarity``.

    1. Texts are indexed by 16 sets of positions.  Lists of one text and lists of the same texts as another
       list's go.
    2. The shingle sets of the texts left are made, and each list is compared in a task, the pairs sharing
       most bytes first: a pair that shares ``LEAST`` of 64 bytes and is not joined yet is verified.  Lists of
       more than ``PART`` texts are dealt into parts first.
    3. In a list of several parts, all texts outside its largest component visit all parts.  So every pair of
       a list that shares enough bytes is verified or joined already, and a group of near copies costs its
       size; no pair is a row.

    known: (src, dst) links found and verified elsewhere; they count like those found here.

    Null counts as empty; texts without words are alike.  Repeated rows are one text; an empty table gives an
    empty result; other columns are ignored.
    """
    index = materialize(_index(docs, size), "posting-keys")
    keyed = index.select("node", F.explode(F.array(*[f"k{i}" for i in range(BANDS)])).alias("key"))
    lists = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    lists = lists.groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key")).select("key", "n")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / PART)).cast("int")
    members = materialize(keyed.join(lists, "key").select("key", "node", "n", part.alias("part")), "lists")
    sets = materialize(_sets(docs, members.select("node").distinct(), size), "shingle-sets")
    own = members.select("key", "part", "node", F.lit(False).alias("visits"), F.col("node").alias("label")).join(sets, "node")
    edges = materialize(_links(own, similarity), "verified")
    edges = edges if known is None else edges.select("src", "dst").union(known.select("src", "dst"))
    large = members.where(F.col("n") > PART)
    if large.isEmpty():
        return components(edges)
    roots = components(edges)
    labelled = large.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("key", "node", "n", "part", F.coalesce("root", "node").alias("label"))
    labelled = materialize(labelled, "labelled")
    main = labelled.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    outside = labelled.join(main, "key").where("label <> main")
    visits = outside.select("key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / PART).cast("int") - 1)).alias("part"), "node", F.lit(True).alias("visits"), "label")
    met = labelled.join(outside.select("key").distinct(), "key", "left_semi").select("key", "part", "node", F.lit(False).alias("visits"), "label")
    more = materialize(_links(met.unionByName(visits).join(sets, "node"), similarity), "verified")
    if more.isEmpty():
        return roots
    # the first round's components, as stars, stand for its links
    return components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(more))


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, component_id, stays, n_rows: one row per distinct (doc_id, text), which n_rows rows have.

    component_id: the smallest doc_id of the text's group (see ``text_groups``; copies of a text are one
    group), null if all ids of the group are null.  stays: true for one row of each group, that of the smallest
    doc_id, nulls last, and of equal ids that of the smallest text hash.

    A doc_id that comes with several texts is several documents; a null doc_id takes part like any other.
    """
    rows = materialize(docs.select("doc_id", text_hash().alias("text_hash")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_rows")), "ids")
    roots = text_groups(docs, size, similarity, known)
    # a group that holds a third of all rows is one row per map task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text")))
    by_text = materialize(
        rows.groupBy("text_hash").agg(first.alias("first")).join(roots, F.col("text_hash") == F.col("node"), "left")
        .select("text_hash", "first", F.coalesce("root", "text_hash").alias("root")), "first-of-text",
    )
    winners = by_text.groupBy("root").agg(F.min("first").alias("best"))
    named = by_text.join(winners, "root").select(F.col("text_hash").alias("h"), "best")
    joined = rows.join(named, F.col("text_hash") == F.col("h"))
    return joined.select(
        "doc_id", "text_hash", F.col("best.id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text"))).alias("stays"), "n_rows",
    )
