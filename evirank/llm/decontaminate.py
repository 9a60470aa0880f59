"""Benchmark decontamination with suffix arrays of the training texts."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, batches, broadcast_if_small, bytes_of, materialize, quoted, text_hash

#: Benchmark text of one broadcast block at most; more items make more blocks, which tasks load in turn.
BLOCK_BYTES = 32 << 20
#: A training shard's suffix array has about so many words.
SHARD_WORDS = 1_000_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM).split()


class Items:
    """A block of benchmark items as word numbers: 1.. in sorted order, 0 for a word no item has."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        # items of the same words are one text with several ids
        texts: dict[tuple[bytes, ...], set[str]] = {}
        for i, t in items:
            if w := words(t):
                texts.setdefault(tuple(w), set()).add(i)
        split = [(sorted(ids), w) for w, ids in texts.items()]
        self.ids = [ids for ids, _ in split]
        self.number = {w: k + 1 for k, w in enumerate(sorted({x for _, w in split for x in w}))}
        text = [self.number[x] for _, w in split for x in w]
        sizes = np.array([len(w) for _, w in split], np.int64)
        ends = np.cumsum(sizes)
        self.first = ends - sizes
        # every suffix of every item: where it starts, how long it is, its item, and if it starts a window
        self.item = np.repeat(np.arange(len(split)), sizes)
        self.length = np.repeat(ends, sizes) - np.arange(len(text))
        self.window = np.minimum(window, np.repeat(sizes, sizes))
        self.starts = self.length >= self.window
        self.text = np.concatenate((np.array(text, np.int32), np.zeros(window + 1, np.int32)))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` whose first word is not 0, sorted by their first ``depth`` words
    (0 ends a suffix: it sorts first and never matches).  Four words are packed into each sort key, and
    each round sorts only the runs that are still tied."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(4, np.int32))).astype(np.uint64)
    wide = int(text.max(initial=0)) >= 1 << 16
    take = 2 if wide else 4
    bits = np.uint64(32 if wide else 16)

    def key(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        live = np.ones(len(at), bool)
        for j in range(take):
            word = padded[np.minimum(at + j, n)]
            live &= word > 0
            out = (out << bits) | np.where(live, word, 0)
        return out

    sa = np.flatnonzero(text)
    if not len(sa):
        return sa
    keys = key(sa)
    order = np.argsort(keys, kind="stable")
    sa, keys = sa[order], keys[order]
    last = (np.uint64(1) << bits) - np.uint64(1)
    run = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
    at = take
    open_ = np.flatnonzero((keys & last) > 0)
    while at < depth and len(open_):
        # suffixes whose keys are full and shared go on
        mine = run[open_]
        twin = np.zeros(len(mine), bool)
        same = mine[1:] == mine[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        open_ = open_[twin]
        if not len(open_):
            break
        keys = key(sa[open_] + at)
        order = np.lexsort((keys, run[open_]))
        sa[open_] = sa[open_][order]
        keys, mine = keys[order], run[open_]
        new = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]) | (mine[1:] != mine[:-1]))))
        run[open_] = new
        open_, at = open_[(keys & last) > 0], at + take
    return sa


def search(text: np.ndarray, sa: np.ndarray, items: Items, queries: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item suffix in ``queries`` the range of the suffix array whose suffixes start with its
    first ``length`` words, by binary search of all of them at once."""
    most = int(length.max(initial=0))
    padded = np.concatenate((text, np.zeros(most + 1, np.int32)))

    def bound(right: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(sa), np.int64)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo]) >> 1
            less = np.full(len(todo), right)  # of equals: go right of them, or not
            live, at = np.arange(len(todo)), sa[mid]
            for j in range(most):
                a, b = padded[at[live] + j], items.text[queries[todo[live]] + j]
                differ = a != b
                less[live[differ]] = a[differ] < b[differ]
                live = live[~differ & (length[todo[live]] > j + 1)]
                if not len(live):
                    break
            low[todo[less]] = mid[less] + 1
            high[todo[~less]] = mid[~less]

    return bound(False), bound(True)


def scan(texts: list[bytes | None], items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One shard: word offsets of its documents, which words windows cover, and the maximal verbatim
    matches as rows (document, item, first word in the document, in the item, words)."""
    get = items.number.get
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        sizes[i] = len(w)
        parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), np.zeros(1, np.int32)]
    text = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    cover = np.zeros(len(text), bool)
    none = np.zeros((0, 5), np.int64)
    query = np.flatnonzero(items.starts)
    if not len(query) or not len(text):
        return offsets, cover, none
    sa = suffix_array(text, int(items.window.max()))
    low, high = search(text, sa, items, query, items.window[query])
    count = high - low
    if not count.sum():
        return offsets, cover, none
    suffix = np.repeat(query, count)
    at = sa[np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + items.window[suffix], -1)
    cover = np.cumsum(edge[:-1]) > 0
    # windows that follow each other in both texts are one longer match
    order = np.lexsort((at, at - suffix, items.item[suffix]))
    at, suffix = at[order], suffix[order]
    item, shift = items.item[suffix], at - suffix
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    doc = np.searchsorted(offsets, at[first], "right") - 1
    at, suffix, item = at[first], suffix[first], item[first]
    found = np.stack((doc, item, at - offsets[doc], suffix - items.first[item], run + items.window[suffix] - 1), 1)
    return offsets, cover, found[np.lexsort((found[:, 3], found[:, 1], found[:, 2], found[:, 0]))]


def _pack(benchmark: DataFrame, window: int, block_bytes: int) -> list[Broadcast]:
    """The benchmark in broadcast blocks of at most ``block_bytes`` of text, or one item if that is longer."""
    spark = benchmark.sparkSession
    out, block, size = [], [], 0
    close = lambda: out.append(spark.sparkContext.broadcast(zlib.compress(pickle.dumps(block), 1)))
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.orderBy("i", "t").toLocalIterator():
        data = r.t.encode()
        if block and size + len(data) > block_bytes:
            close()
            block, size = [], 0
        block.append((r.i, data))
        size += len(data)
    close()
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items, spans, matches: one row per input row.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.  A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  Each
    training shard (whole documents, about ``shard_words`` words, of the batches that its task reads) gets
    a suffix array over the suffixes that begin with a benchmark word; every item suffix that starts a
    window is searched for in it.  spans: (start, end) word ranges that windows cover, merged; n_hit: the
    words in them; matches: the longest verbatim matches, with their places in document and item (of items with
    the same words, the smallest id); items: the ids of all items with an occurring window, sorted as strings.

    Null and empty texts have no words; items without words have no window; repeated rows and items count
    each, but an id is listed once (a null id as ''); an empty benchmark hits nothing; an empty table gives
    an empty result; other columns are ignored.  Nothing is shuffled: memory is bounded by one shard, one
    benchmark block and the longest document.
    """
    blocks = _pack(benchmark, window, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    match = pa.struct([("item", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Items] = {}

        def items_of(k: int) -> Items:
            if k not in held:
                held.clear()  # one block at a time
                held[k] = Items(pickle.loads(zlib.decompress(blocks[k].value)), window)
            return held[k]

        def shard(ids: pa.Array, hashes: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
            cover, offsets, found = None, np.zeros(1, np.int64), [[] for _ in texts]
            listed: list[set[str]] = [set() for _ in texts]
            for k in range(len(blocks)):
                items = items_of(k)
                offsets, mine, rows = scan(texts, items)
                cover = mine if cover is None else cover | mine
                for doc, *m in rows.tolist():
                    found[doc].append((items.ids[m[0]][0], *m[1:]))
                    listed[doc].update(items.ids[m[0]])
            total = np.concatenate(([0], np.cumsum(cover)))
            hit = total[offsets[1:]] - total[offsets[:-1]]
            spans: list[list] = [[] for _ in texts]
            for i in np.flatnonzero(hit).tolist():
                edge = np.flatnonzero(np.diff(cover[offsets[i] : offsets[i + 1]].astype(np.int8), prepend=0))
                spans[i] = [{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()]
            return pa.RecordBatch.from_arrays(
                [
                    ids, hashes, pa.array(np.diff(offsets) - 1, pa.int64()), pa.array(hit, pa.int64()),
                    pa.array([sorted(x) for x in listed], pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
                    pa.array([[dict(zip(("item", "doc_start", "item_start", "words"), m, strict=True)) for m in f] for f in found], pa.list_(match)),
                ],
                ["doc_id", "text_hash", "n_words", "n_hit", "items", "spans", "matches"],
            )

        for b in batches(rows):
            texts, size, first = [], 0, 0
            for at, text in enumerate(bytes_of(b.column(1))):
                texts.append(text)
                size += len(text or b"")
                if size >= 6 * shard_words or at == b.num_rows - 1:  # about six bytes a word
                    yield shard(b.column(0).slice(first, at + 1 - first), b.column(2).slice(first, at + 1 - first), texts)
                    texts, size, first = [], 0, at + 1

    return docs.select("doc_id", F.col("text").cast("string"), text_hash()).mapInArrow(
        run,
        f"doc_id {kind}, text_hash long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, "
        "matches array<struct<item:string,doc_start:long,item_start:long,words:long>>",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents that hold no window of any item, with all their columns, whatever the names.

    Each row is judged by its own text; rows of a doc_id, or without one, stay or go on their own.  Null and empty
    texts stay; an empty benchmark keeps all; an empty table gives an empty result.
    """
    hit = matches(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias("__hit_id"), F.col("text_hash").alias("__hit_text")).distinct()
    hit = broadcast_if_small(materialize(hit, "contaminated"))
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), text_hash().alias("__text"))
    kept = rows.join(hit, F.col("__id").eqNullSafe(F.col("__hit_id")) & (F.col("__text") == F.col("__hit_text")), "left_anti")
    return kept.select("__row.*")
