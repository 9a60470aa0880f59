"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import ASCII_SPACE, LOWER, batches, bytes_of, materialize, quoted


#: Common keys that are sent to all documents: 16 bytes of key, two or three of filter and a doc_id each.
BROADCAST_LINES = 500_000


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).translate(LOWER)


def code_points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


class Cuckoo:
    """A cuckoo filter (Fan et al., 2014) with 4 slots a bucket and 16-bit fingerprints, filled in bulk.

    Takes 16-byte digests as (n, 2) uint64.  A lookup has no false negatives; deletion removes one copy
    of the fingerprint, so only keys that were inserted may be deleted, as the exact tables assure.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(capacity / (self.SLOTS * 0.8)).bit_length())
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((keys[:, 1] >> np.uint64(48)).astype(np.uint16) % np.uint16(65535)) + np.uint16(1)
        one = keys[:, 0] & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """All keys, in rounds: of those that want a bucket one goes in, and a full bucket gives up a slot."""
        if not len(keys):
            return
        mark, at, two = self._places(keys)
        free = lambda b: (self.table[b] == 0).any(1)
        at = np.where(~free(at) & free(two), two, at)
        for step in range(2000):
            if not len(mark):
                return
            _, pick = np.unique(at, return_index=True)
            go = np.zeros(len(mark), bool)
            go[pick] = True
            b, m = at[go], mark[go]
            room = self.table[b] == 0
            has = room.any(1)
            slot = np.where(has, room.argmax(1), (m.astype(np.int64) + step) % self.SLOTS)
            out = self.table[b, slot]
            self.table[b, slot] = m
            out_b = self._other(b[~has], out[~has])
            mark, at = np.concatenate((mark[~go], out[~has])), np.concatenate((at[~go], out_b))
        raise OverflowError("the cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        for m, a, b in zip(mark, one, two, strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == m)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break
            else:
                raise KeyError("the filter does not hold the key")

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Cuckoo:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def _halves(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def postings(docs: DataFrame, min_chars: int = 40, shards: int = 64) -> DataFrame:
    """(key, shard, doc_id), distinct: the 16-byte digests of the keys of at least ``min_chars`` code points."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            keys, shard, at = [], [], []
            for i, text in enumerate(bytes_of(b.column(1))):
                for key in {k for k in map(line_key, (text or b"").split(b"\n")) if len(k) >= min_chars and code_points(k) >= min_chars}:
                    keys.append(d := digest(key))
                    shard.append(int.from_bytes(d[8:12], "little") % shards)
                    at.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(shard, pa.int32()), b.column(0).take(pa.array(at, pa.int64()))], ["key", "shard", "doc_id"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"key binary, shard int, doc_id {kind}").distinct()


@dataclass
class LineIndex:
    """postings: (key, shard, doc_id), exact.  deltas: (key, shard, n_docs, keeper), what each insert added to
    the exact reference counts and largest doc_ids; ``refs`` sums them up.  filters: (shard, filter), a
    cuckoo filter of a shard's keys.  All are tables in the shared folder; a change adds to them or makes new
    ones, so an old index stays valid."""

    postings: DataFrame
    deltas: DataFrame
    filters: DataFrame
    min_chars: int
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, id_type: str, min_chars: int = 40, shards: int = 64) -> LineIndex:
        make = lambda spec: spark.createDataFrame([], spec)
        return cls(
            make(f"key binary, shard int, doc_id {id_type}"), make(f"key binary, shard int, n_docs long, keeper {id_type}"),
            make("shard int, filter binary"), min_chars, shards,
        )

    @property
    def refs(self) -> DataFrame:
        """(key, shard, n_docs, keeper): the exact reference count and the largest doc_id of each key."""
        return self.deltas.groupBy("key", "shard").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents' lines added; postings it has already do not count again.

        Keys that a shard's filter rules out are new: no exact table is read for them.  Only the others meet
        the postings and counts that they may have.  Postings and counts grow by what is new, a filter takes
        the new keys in, and only a filter without room for them is built again.
        """
        fresh = materialize(postings(docs, self.min_chars, self.shards), "fresh")
        if self.filters.isEmpty():
            delta = materialize(_count(fresh), "delta")
            return LineIndex(fresh, delta, materialize(_filters(delta), "filters"), self.min_chars, self.shards)
        keys = fresh.select("key", "shard").distinct()
        probed = materialize(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, "key binary, shard int, seen boolean"), "probed")
        seen = probed.where("seen").select(F.col("key").alias("k"))
        had = self.postings.join(seen, F.col("key") == F.col("k"), "left_semi").select(F.col("key").alias("k"), F.col("doc_id").alias("d"))
        fresh = materialize(fresh.join(had, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti").select("key", "shard", "doc_id"), "fresh")
        # a filter may take a new key for an old one: it goes in like the others, so that it can be deleted
        known = self.deltas.select(F.col("key").alias("k"))
        new = probed.where("not seen").select("key", "shard").union(probed.where("seen").select("key", "shard").join(known, F.col("key") == F.col("k"), "left_anti"))
        deltas = self.deltas.union(materialize(_count(fresh), "delta"))
        taken = materialize(self.filters.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_take, "shard int, filter binary"), "taken")
        full = taken.where("filter is null").select(F.col("shard").alias("s"))
        again = _filters(deltas.select("key", "shard").distinct().join(F.broadcast(full), F.col("shard") == F.col("s"), "left_semi"))
        filters = materialize(taken.where("filter is not null").union(again), "filters")
        return LineIndex(self.postings.union(fresh), deltas, filters, self.min_chars, self.shards)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ``ids`` (column doc_id): counts go down, keepers are found
        again from the postings of the keys concerned, and keys without documents leave the filters."""
        ids = ids.select(F.col("doc_id").alias("gone")).distinct()
        rest = materialize(self.postings.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti"), "postings")
        touched = self.postings.join(ids, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("key", "shard").distinct()
        touched = materialize(touched, "touched")
        again = _count(rest.join(touched.select("key"), "key", "left_semi").select("key", "shard", "doc_id"))
        refs = materialize(self.refs.join(touched.select("key"), "key", "left_anti").select("key", "shard", "n_docs", "keeper").union(again), "refs")
        dead = touched.join(refs.select("key"), "key", "left_anti").select("shard", "key")
        filters = materialize(self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(_forget, "shard int, filter binary"), "filters")
        return LineIndex(rest, refs, filters, self.min_chars, self.shards)

    def drops(self, common: DataFrame) -> DataFrame:
        """(doc_id, keys): the digests of the lines that each document loses."""
        many = common.select(F.col("key").alias("k"), "keeper")
        lost = self.postings.join(many, self.postings.key == F.col("k")).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, min_docs: int = 5, keep: list[Column | str] = ()) -> DataFrame:
        """doc_id, text (the lines that stay, joined by newlines), n_lines, n_dropped, the columns ``keep``.

        Up to ``BROADCAST_LINES`` common keys go to the documents: a cuckoo filter of them is asked for every
        long line, and the lines it lets through are looked up in the exact table of keepers.  No text is
        shuffled.  More common keys meet the postings in a shuffle, and the documents their lost keys.
        """
        common = materialize(self.refs.where(F.col("n_docs") >= min_docs).select("key", "keeper"), "common")
        source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
        if common.count() <= BROADCAST_LINES:
            table = docs.sparkSession.sparkContext.broadcast(Keepers.of(common.toArrow()))
            return _edited(source, None, lambda: table.value, self.min_chars)
        drops = self.drops(common).select(F.col("doc_id").alias("__lost_id"), F.col("keys").alias("__keys"))
        both = source.join(drops, F.col("doc_id").eqNullSafe(F.col("__lost_id")), "left")
        return _edited(both, "__keys", None, self.min_chars)


@dataclass
class Keepers:
    """The common keys: a cuckoo filter in front of the exact table, sorted digests and their keepers."""

    filter: bytes
    keys: np.ndarray
    ids: list

    @classmethod
    def of(cls, rows: pa.Table) -> Keepers:
        halves = _halves(rows["key"])
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        filled = Cuckoo(len(halves))
        filled.insert(halves)
        return cls(filled.dump(), halves[order], rows["keeper"].take(pa.array(order)).to_pylist())

    def lost(self, wanted: Cuckoo, digests: list[bytes], doc_ids: list) -> np.ndarray:
        """Which of the lines, given by digest and document, are common and have another keeper."""
        out = np.zeros(len(digests), bool)
        if not len(self.keys) or not digests:
            return out
        asked = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        maybe = np.flatnonzero(wanted.contains(asked))
        first = np.searchsorted(self.keys[:, 0], asked[maybe, 0])
        for i, at in zip(maybe.tolist(), first.tolist(), strict=True):
            while at < len(self.keys) and self.keys[at, 0] == asked[i, 0]:
                if self.keys[at, 1] == asked[i, 1]:
                    out[i] = self.ids[at] != doc_ids[i]
                    break
                at += 1
        return out


def _edited(source: DataFrame, keys: str | None, keepers, min_chars: int) -> DataFrame:
    """Rows (doc_id, text, ...) without the lines they lose, by the column ``keys`` of digests or by ``keepers``."""
    kept = [f for f in source.schema.fields[2:] if f.name not in ("__lost_id", "__keys")]
    columns = ["doc_id", "text", *(quoted(f.name) for f in kept), *([keys] if keys else [])]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = keepers() if keepers else None
        wanted = Cuckoo.load(table.filter) if table else None
        for b in batches(rows):
            ids, texts, lines, dropped = b.column(0).to_pylist(), bytes_of(b.column(1)), [], []
            lost_keys = b.column(2 + len(kept)).to_pylist() if keys else [None] * len(ids)
            split = [(t or b"").split(b"\n") for t in texts]
            digests, of_doc, at = [], [], []
            for i, parts in enumerate(split):
                if keys and not lost_keys[i]:
                    continue
                for j, x in enumerate(parts):
                    if len(x) >= min_chars and len(k := line_key(x)) >= min_chars and code_points(k) >= min_chars:
                        digests.append(digest(k))
                        of_doc.append(i)
                        at.append(j)
            if keys:
                sets = {i: set(lost_keys[i]) for i in set(of_doc)}
                lost = [d in sets[i] for d, i in zip(digests, of_doc, strict=True)]
            else:
                lost = table.lost(wanted, digests, [ids[i] for i in of_doc]).tolist()
            gone: dict[int, set[int]] = {}
            for i, j, x in zip(of_doc, at, lost, strict=True):
                if x:
                    gone.setdefault(i, set()).add(j)
            for i, parts in enumerate(split):
                out = gone.get(i, ())
                lines.append(len(parts))
                dropped.append(len(out))
                if out:
                    texts[i] = b"\n".join([x for j, x in enumerate(parts) if j not in out])
            made = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), made, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *(b.column(2 + i) for i in range(len(kept)))],
                ["doc_id", "text", "n_lines", "n_dropped", *(f.name for f in kept)],
            )

    made = StructType([*source.schema.fields[:2], *StructType.fromDDL("n_lines long, n_dropped long").fields, *kept])
    return source.select(*columns).mapInArrow(run, made)


def _count(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "shard").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def _filters(keys: DataFrame) -> DataFrame:
    return keys.select("shard", "key").groupBy("shard").applyInArrow(_build, "shard int, filter binary")


def _build(rows: pa.Table) -> pa.Table:
    filled = Cuckoo(2 * rows.num_rows)
    filled.insert(_halves(rows["key"]))
    return pa.table({"shard": pa.array(rows["shard"].to_pylist()[:1], pa.int32()), "filter": pa.array([filled.dump()], pa.binary())})


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    data = filters["filter"].to_pylist()
    seen = Cuckoo.load(data[0]).contains(_halves(rows["key"])) if data and rows.num_rows else np.zeros(rows.num_rows, bool)
    return rows.select(["key", "shard"]).append_column("seen", pa.array(seen, pa.bool_()))


def _take(filters: pa.Table, new: pa.Table) -> pa.Table:
    """A shard's filter with the new keys; null if it has no room for them."""
    data = filters["filter"].to_pylist()
    shard = (filters["shard"] if data else new["shard"]).to_pylist()[:1]
    if data and not new.num_rows:
        return pa.table({"shard": pa.array(shard, pa.int32()), "filter": pa.array(data, pa.binary())})
    held = Cuckoo.load(data[0]) if data else Cuckoo(2 * new.num_rows)
    room = np.count_nonzero(held.table == 0) - 0.2 * held.table.size >= new.num_rows
    if room:
        held.insert(_halves(new["key"]))
    return pa.table({"shard": pa.array(shard, pa.int32()), "filter": pa.array([held.dump() if room else None], pa.binary())})


def _forget(filters: pa.Table, dead: pa.Table) -> pa.Table:
    kept = [Cuckoo.load(x) for x in filters["filter"].to_pylist()]
    if kept and dead.num_rows:
        kept[0].delete(_halves(dead["key"]))
    return pa.table({"shard": filters["shard"], "filter": pa.array([x.dump() for x in kept], pa.binary())})


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shards: int | None = None, keep: list[Column | str] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, the columns ``keep``: lines whose key is long and common stay in the
    largest doc_id only.

    One row per input row.  Null or empty text: one empty line (text stays null or empty).  Null doc_ids
    count as one document below all others; rows that repeat a doc_id count as one document.  Repeats of a
    key inside a document are all kept or all dropped.  Empty table: empty result; other columns are
    ignored.  A line that a third of all documents share is one row per map task after the first combine.

    shards: one per 100,000 documents, at least 16, by default; more shards bound a filter's size.
    """
    if shards is None:
        shards = max(16, docs.select("doc_id").count() // 100_000)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return LineIndex.empty(docs.sparkSession, kind, min_chars, shards).insert(docs).apply(docs, min_docs, keep)
