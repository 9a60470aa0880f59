"""Spelling variants: words one edit apart, found by generating the full neighbourhood of every word.

All distinct deletions, replacements and insertions of each word over the observed alphabet are the keys of an
equi-join with the vocabulary, so a match is one edit away by construction and no distance is computed.  Candidates are
generated as 64-bit hashes first, whole arrays at once: the hash of an edited word follows from the sums of the word's
prefix and suffix.  A Bloom filter of the vocabulary, at most 2**``LOG_FILTER`` bits whatever the input, drops most candidates
that are no word; those that pass become strings, and the join on the strings decides.  It has no false drops, and
where the vocabulary outgrows it only more candidates reach the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batches, materialize

LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Distinct (word, count) pairs that a task holds before it sends them on.
HELD_WORDS = 250_000
#: A text this long is read match by match, not into one list.
LONG_TEXT = 1 << 22
#: Bits of the filter for each word; log2 of the bits of the whole filter (at most 128 MB) and of one of its blocks.
BITS_A_WORD, LOG_FILTER, LOG_BLOCK = 24, 30, 20
#: Candidates that are hashed at once.
CHUNK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_UNBASE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def occurrences(docs: DataFrame, drop_one_in: int | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of all texts and how often they occur.

    ``drop_one_in``: where it divides the crc32 of ``<doc_id>:<run>``, the run loses the code point at that value modulo
    its length, which makes known misspellings.  A null id stands as the empty string there; repeated rows count each.
    """
    most, long = HELD_WORDS, LONG_TEXT

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for b in batches(rows):
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                text = raw.translate(LOWER).decode(errors="replace")
                found = LETTERS.findall(text) if len(text) < long else (m[0] for m in LETTERS.finditer(text))
                if drop_one_in is None:
                    held.update(found)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for w, n in Counter(found).items():
                        h = zlib.crc32(w.encode(), start)
                        if h % drop_one_in == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                        held[w] += n
                if len(held) >= most:
                    yield out()
        if held:
            yield out()

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_codes(alphabet: str) -> np.ndarray:
    """A fixed random 64-bit number for each letter."""
    x = np.array([ord(c) for c in alphabet], _U) * _U(0xBF58476D1CE4E5B9) + _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def powers(n: int) -> np.ndarray:
    return np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _BASE))]) if n > 1 else np.ones(n, _U)


def word_hashes(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sum of code times power of the place, modulo 2**64.  places: words of one length, as alphabet indexes."""
    return (codes[places] * powers(places.shape[1])).sum(1, dtype=_U)


class Filter:
    """A Bloom filter in blocks: some bits of a mixed hash choose the block, others three bits of it."""

    def __init__(self, log_bits: int):
        self.log_block, self.log_blocks = LOG_BLOCK, max(0, log_bits - LOG_BLOCK)
        self.bits = np.zeros(0, np.uint8)

    def fill(self, blocks: Iterator[tuple[int, bytes]]) -> Filter:
        self.bits = np.zeros((1 << self.log_blocks + self.log_block) // 8, np.uint8)
        for at, block in blocks:
            self.bits[at << self.log_block - 3 : (at + 1) << self.log_block - 3] = np.frombuffer(block, np.uint8)
        return self

    def places(self, h: np.ndarray, probe: int) -> np.ndarray:
        x = (h ^ (h >> _U(32))) * _U((0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9FB21C651E98DF25)[probe])
        inner = x >> _U(64 - self.log_block)
        if not self.log_blocks:
            return inner
        return ((h ^ (h >> _U(29))) * _U(0x2545F4914F6CDD1D) >> _U(64 - self.log_blocks)) << _U(self.log_block) | inner

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes that may be in the filter."""
        left = np.arange(len(h))
        for probe in range(3):
            at = self.places(h[left], probe)
            left = left[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0]
        return left


def build_filter(words: DataFrame, n: int, alphabet: str) -> Filter:
    """The filter of n words.  A block's task gets each of its places once, so at most as many rows as it has bits."""
    held = Filter(min((max(n, 1) * BITS_A_WORD - 1).bit_length(), LOG_FILTER))
    size = 1 << held.log_block
    codes = letter_codes(alphabet)

    def places(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for _, _, _, x in by_length(b, alphabet):
                h = word_hashes(x, codes)
                at = np.unique(np.concatenate([held.places(h, i) for i in range(3)])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32))], ["block", "place"])

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        bits[table.column("place").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1].combine_chunks(), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = words.select("word").mapInArrow(places, "block int, place int").distinct().groupBy("block").applyInArrow(block, "block int, bits binary")
    return held.fill((r.block, bytes(r.bits)) for r in found.toLocalIterator())


def by_length(b: pa.RecordBatch, alphabet: str) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """Length, the words of that length, their rows, and their letters as alphabet indexes."""
    index = np.zeros(max(map(ord, alphabet), default=0) + 1, np.uint8)
    for i, c in enumerate(alphabet):
        index[ord(c)] = i
    words = b.column(0).to_pylist()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        own = [words[i] for i in rows]
        # UTF-32: a fixed width for each letter
        yield int(n), own, rows, index[np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), n)]


def neighbourhood(x: np.ndarray, codes: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """The hashes of all deletions, replacements and insertions of words of one length, as (kind, first place, hashes,
    distinct); axes: word, place[, letter].  ``distinct`` is False where an entry repeats another or the word itself.
    Places come in ranges, so that a very long word is no large array."""
    n, size = x.shape[1], len(codes)
    p = powers(n + 1)
    terms = codes[x] * p[:n]
    before = np.concatenate([np.zeros((len(x), 1), _U), np.cumsum(terms, axis=1, dtype=_U)], axis=1)
    whole = before[:, -1:]
    # a run of one letter loses the same letter at any place: the first stands for all
    first = np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1)
    yield "delete", 0, before[:, :n] + (whole - before[:, 1:]) * _UNBASE, first
    step, letters = max(1, CHUNK // (len(x) * size)), np.arange(size, dtype=x.dtype)
    for a in range(0, n, step):
        at = slice(a, min(a + step, n))
        yield "replace", a, (whole - terms[:, at])[:, :, None] + codes * p[at, None], x[:, at, None] != letters
    for a in range(0, n + 1, step):
        at = slice(a, min(a + step, n + 1))
        # a letter behind its equal gives the same word as before it
        behind = x[:, max(a - 1, 0) : at.stop - 1, None] != letters
        behind = behind if a else np.concatenate([np.ones((len(x), 1, size), bool), behind], axis=1)
        yield "insert", a, (before[:, at] + (whole - before[:, at]) * _BASE)[:, :, None] + codes * p[at, None], behind


def candidates(words: DataFrame, alphabet: str, known: Filter) -> DataFrame:
    """candidate, word, n: the neighbours of each word that pass the filter, each once.  words: word, n."""
    codes = letter_codes(alphabet)
    sent = words.sparkSession.sparkContext.broadcast(known)

    def edited(own: list[str], kind: str, start: int, at: np.ndarray, shape: tuple[int, ...]) -> list[str]:
        i, p, *c = np.unravel_index(at, shape)
        i, p, c = i.tolist(), (p + start).tolist(), [a.tolist() for a in c]
        if kind == "delete":
            return [own[i][:p] + own[i][p + 1 :] for i, p in zip(i, p, strict=True)]
        skip = kind == "replace"
        return [own[i][:p] + alphabet[c] + own[i][p + skip :] for i, p, c in zip(i, p, *c, strict=True)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            for n, own, at, x in by_length(b, alphabet):
                step = max(1, CHUNK // ((n + 1) * len(alphabet)))
                for i in range(0, len(own), step):
                    for kind, start, h, distinct in neighbourhood(x[i : i + step], codes):
                        some = np.flatnonzero(distinct)
                        some = some[sent.value.passing(h.reshape(-1)[some])]
                        if len(some):
                            of = pa.array(at[i + some // (h.size // len(h))])
                            yield pa.RecordBatch.from_arrays([pa.array(edited(own[i : i + step], kind, start, some, h.shape), pa.string()), b.column(0).take(of), b.column(1).take(of)], ["candidate", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "candidate string, word string, n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that following the forms leads to.  forms: word, form; every word once, no circles.
    Each round doubles the steps taken, so a chain of c forms takes log2(c) rounds; words that have their root are not
    joined again, others look theirs up."""
    step = materialize(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "forms")
    while not step.where("not done").isEmpty():
        on = step.select(F.col("word").alias("__word"), F.col("root").alias("__root"), F.col("done").alias("__done"))
        opened = step.where("not done").join(on, F.col("root") == F.col("__word"), "left")
        moved = opened.select("word", F.coalesce("__root", "root").alias("root"), (F.col("__word").isNull() | F.col("__done")).alias("done"))
        step = materialize(step.where("done").union(moved), "forms")
    return step.select("word", "root")


def variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_one_in: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least ``min_length`` code points and ``min_count``
    occurrences: n_near words differ by one edit; the form is the most frequent of them (ties: the smallest in code-point
    order) if it is at least ``ratio`` times as frequent; the root is the last word that forms lead to.

    Null texts have no words.  Very long texts are read match by match; their words count like others.  Repeated rows
    count each, null ids too.  Only doc_id and text are read, so other columns may have any name.  An empty table gives
    an empty result.
    """
    if min_count < 1 or ratio < 2:
        raise ValueError("min_count must be at least 1 and ratio at least 2, so that forms cannot lead in circles")
    words = materialize(occurrences(docs, drop_one_in).where((F.col("n") >= min_count) & (F.length("word") >= min_length)), "words")
    # at most 90 letters
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    # the relation is symmetric, so the words that arrive at a candidate are that word's neighbours
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form")))
    near = candidates(words, alphabet, build_filter(words, words.count(), alphabet)).groupBy("candidate").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, F.col("word") == F.col("candidate"), "left")
    far = -F.col("best.less") >= ratio * F.col("n")
    found = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "forms")
    rest = roots(found.where("form is not null")).withColumnRenamed("word", "__word")
    return found.join(rest, F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
