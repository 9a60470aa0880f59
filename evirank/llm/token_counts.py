"""Token counts: the exact count of a byte-level BPE at every prefix of a text, by dynamic programming.

The last token of a prefix decides its count: of the tokens that end there, just one goes with the last token of the
prefix before it, that is, the merges leave the two as they are.  So the counts of all prefixes of a piece come from
one pass over its places, and a text's counts are those of its pieces, added up.  Truncation and budget questions are
answered from the counts; no text is encoded again.

A worker remembers the tables of at most ``REMEMBERED`` pieces and makes others again when they are needed again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import batches, quoted

# The split of the byte-level vocabulary; for text up to U+00FF its classes are spelt out, which is faster.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
LATIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Contractions that stay two pieces until their last letter is there.
CONTRACTIONS = ("'re", "'ve", "'ll")

SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: Letters beyond these may be of another class in the library's Unicode version than in the regex module's.
BEYOND = re.compile("[^\x00-՗]")
#: Tables of pieces of at most SHORT code points that a worker remembers, and code points of text that it takes at once.
REMEMBERED, SHORT, AT_ONCE = 500_000, 60, 1 << 21


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the others from
    U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Prefixes:
    """Counts of a byte-level BPE (the JSON of the tokenizers library) at every prefix of a text."""

    def __init__(self, spec: str):
        held = json.loads(spec)
        model, letters = held["model"], byte_letters()
        if model["type"] != "BPE" or held["normalizer"] or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer or added space is needed")
        raw = lambda token: bytes(letters[c] for c in token)
        self.specials = [a["content"] for a in held["added_tokens"]]
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.merges = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.longest = max(map(len, self.ids))
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.library = Tokenizer.from_str(spec).pre_tokenizer
        self.goes: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.alike: set[str] = set()
        self.unlike: set[str] = set()

    def encode(self, piece: bytes) -> list[int]:
        """The merges by rank, leftmost first: for pairs of tokens only, so short."""
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(ids) > 1:
            rank, at, new = min(((*self.merges[pair][:1], i, self.merges[pair][1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.merges), default=(0, -1, 0))
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave token b behind token a as they are; remembered."""
        if len(self.goes) >= 4 * REMEMBERED:
            self.goes.clear()
        found = self.goes[a << 32 | b] = self.encode(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def learn(self, pieces: set[str]) -> dict[str, np.ndarray]:
        """Make the tables of the pieces that are not known: the counts at each code point of a piece that the split leaves
        whole.  Sorted pieces share the places of their common prefix.  Returns the tables of long pieces, which are not
        remembered."""
        wide, goes, ids, longest = {}, self.goes, self.ids, self.longest
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        before, last, count = b"", [0], [0]
        for text in sorted(new):
            raw = text.encode("utf-8", "surrogatepass")
            n, k = len(raw), 0
            for x, y in zip(before, raw, strict=False):
                if x != y:
                    break
                k += 1
            del last[k + 1 :], count[k + 1 :]
            for j in range(k + 1, n + 1):
                for i in range(j - longest if j > longest else 0, j):
                    token = ids.get(raw[i:j])
                    if token is not None:
                        if not i:
                            break
                        fits = goes.get(last[i] << 32 | token)
                        if self.compatible(last[i], token) if fits is None else fits:
                            break
                last.append(token)
                count.append(count[i] + 1)
            before = raw
            counts = count[1:]
            if text in CONTRACTIONS:  # its first two letters are pieces of their own
                counts[1] = counts[0] + 1
            if n != len(text):
                counts = [c for c, b in zip(counts, [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]
            if len(text) <= SHORT:
                self.known[text] = bytes(counts)
            else:
                wide[text] = np.array(counts, np.int32)
        return wide

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND_LATIN.search(text):
            return LATIN_SPLIT.findall(text)
        if BEYOND.search(text):
            new = set(text) - self.alike
            if new & self.unlike or self._unlike(new - self.unlike):
                return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def _unlike(self, letters: set[str]) -> set[str]:
        """Those letters that the library takes for another class than the regex module."""
        for c in letters:
            probe = f"a{c}a1{c}1 {c} "
            same = [span for _, span in self.library.pre_tokenize_str(probe)] == [m.span() for m in SPLIT.finditer(probe)]
            (self.alike if same else self.unlike).add(c)
        return letters & self.unlike

    def ordinary(self, text: str, pieces: list[str], wide: dict[str, np.ndarray]) -> np.ndarray:
        """Counts at each code point of a text without special strings, from the tables of its pieces."""
        if not text:
            return np.zeros(0, np.int32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if lengths.max() > SHORT:
            local = np.concatenate([wide[p] if p in wide else np.frombuffer(self.known[p], np.uint8) for p in pieces]).astype(np.int32)
        else:
            local = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint8).astype(np.int32)
        own = local[np.cumsum(lengths) - 1]
        counts = (local + np.repeat(np.cumsum(own, dtype=np.int64) - own, lengths)).astype(np.int32)
        for m in SPACES.finditer(text):  # white space at the end of a prefix is one piece, its last letter too
            a, b = m.span()
            if b < len(text):
                run = self.known.get(m[0])
                total = run[-1] if run else (wide[m[0]] if m[0] in wide else self._run(m[0]))[-1]
                counts[b - 1] = (counts[a - 1] if a else 0) + int(total)
        return counts

    def _run(self, piece: str) -> np.ndarray:
        """The table of a run of white space that is no piece of its text, without what is remembered."""
        other = self.learn({piece})
        return other[piece] if piece in other else np.frombuffer(self.known[piece], np.uint8)

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings; all segments but the last end one letter short of the special string's end,
        for that far it is ordinary text to a prefix."""
        if self.split_special is None or not self.split_special.search(text):
            return [text]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append(text[at : m.end() - 1])
            at = m.end()
        return [*out, text[at:]]

    def counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text an array whose entry i is the number of tokens of its first i + 1 code points, as the library
        counts them by default: a special string is one token once it is whole, ordinary text before."""
        cut = [[(s, self.pieces(s)) for s in self.segments(t)] for t in texts]
        wide = self.learn({p for text in cut for _, pieces in text for p in pieces})
        for text, segments in zip(texts, cut, strict=True):
            parts = [self.ordinary(s, pieces, wide) for s, pieces in segments]
            if len(parts) == 1:
                yield parts[0]
                continue
            out, base, at = [], 0, 0
            for part, m in zip(parts, self.split_special.finditer(text), strict=False):
                before = base + (int(part[m.start() - at - 1]) if m.start() > at else 0)
                out += [base + part, [before + 1]]
                base, at = before + 1, m.end()
            yield np.concatenate([*out, base + parts[-1]]).astype(np.int32)

    def each(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray]]:
        """Texts and their counts, some MB of text at once."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from zip(some, self.counts(some), strict=True)
                some, size = [], 0
        yield from zip(some, self.counts(some), strict=True)


@lru_cache(maxsize=2)
def prefixes_of(spec: str) -> Prefixes:
    """One per worker and vocabulary."""
    return Prefixes(spec)


def _texts(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The rows as one struct, so that no name clashes, and the text."""
    return docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _with(rows: DataFrame, **columns: str | T.DataType) -> T.StructType:
    """The schema of the rows' struct and further columns."""
    out = T.StructType([rows.schema["row"]])
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def _spec(spark: SparkSession, tokenizer: str):
    """The vocabulary file's text, sent to the executors: some MB whatever the corpus."""
    with open(tokenizer, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def fit(counts: np.ndarray, budget: int) -> int:
    """The code points of the longest prefix of at most ``budget`` tokens.  Counts may fall where a letter completes a
    token, so it is the last such place."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    return int(np.flatnonzero(np.concatenate([[0], counts]) <= budget)[-1])


def count_tokens(docs: DataFrame, tokenizer: str, budget: int, keep: list[Column] | None = None) -> DataFrame:
    """The kept columns (all without the text, if none are named), n_bytes, n_tokens, over_limit (more tokens than the
    budget) and n_fit (the code points that fit it) of every text, from its prefix counts.

    No row is dropped or shuffled: repeated rows, ties and null ids each have their own result.  A null text counts as
    empty and has 0 tokens; a very long text is one array of 4 bytes a code point.  An empty table gives an empty
    result.  Other columns may have any name; those of a kept column that is called like a result are the caller's.
    """
    keep = [F.col(quoted(c)) for c in docs.columns if c != "text"] if keep is None else keep
    spec = _spec(docs.sparkSession, tokenizer)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = prefixes_of(spec.value)
        for b in batches(rows):
            n_bytes, n_tokens, n_fit = [], [], []
            for text, counts in model.each(b.column(1).to_pylist()):
                n_bytes.append(len(text) if text.isascii() else len(text.encode()))
                n_tokens.append(int(counts[-1]) if len(counts) else 0)
                n_fit.append(fit(counts, budget))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, n_fit))], ["row", "n_bytes", "n_tokens", "n_fit"])

    rows = _texts(docs, keep)
    found = rows.mapInArrow(run, _with(rows, n_bytes="long", n_tokens="long", n_fit="long"))
    return found.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > budget).alias("over_limit"), "n_fit")


#: Differences of neighbouring counts are kept in the first of these that holds all of a text's.
WIDTHS = (np.int8, np.int16, np.int32)


def packed(counts: np.ndarray) -> bytes:
    """A byte for the width, then the differences of neighbouring counts."""
    steps = np.diff(counts, prepend=0)
    low, high = (int(steps.min()), int(steps.max())) if len(steps) else (0, 0)
    kind = next(k for k in WIDTHS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpacked(table: bytes) -> np.ndarray:
    kind = {np.dtype(k).itemsize: k for k in WIDTHS}[table[0]]
    return np.cumsum(np.frombuffer(table, kind, offset=1), dtype=np.int32)


def prefix_tables(docs: DataFrame, tokenizer: str, keep: list[Column] | None = None) -> DataFrame:
    """The kept columns and prefix_table: the counts at every prefix, mostly a byte for each code point, to be stored.
    Rows and odd values as in ``count_tokens``."""
    keep = [F.col(quoted(c)) for c in docs.columns if c != "text"] if keep is None else keep
    spec = _spec(docs.sparkSession, tokenizer)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = prefixes_of(spec.value)
        for b in batches(rows):
            tables = [packed(counts) for _, counts in model.each(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tables, pa.binary())], ["row", "prefix_table"])

    rows = _texts(docs, keep)
    return rows.mapInArrow(run, _with(rows, prefix_table="binary")).select("row.*", "prefix_table")


def answer(tables: DataFrame, places: list[int], budgets: list[int]) -> DataFrame:
    """To the rows of ``prefix_tables``: n_at (tokens of the first so many code points, for each place; beyond the end
    those of the whole text) and n_fit (code points that fit, for each budget).  No text is read."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            all_counts = [unpacked(t) for t in b.column(1).to_pylist()]
            at = [[int(c[min(p, len(c)) - 1]) if p > 0 and len(c) else 0 for p in places] for c in all_counts]
            fits = [[fit(c, x) for x in budgets] for c in all_counts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int64())), pa.array(fits, pa.list_(pa.int64()))], ["row", "n_at", "n_fit"])

    rows = tables.select(F.struct(*[F.col(quoted(c)) for c in tables.columns if c != "prefix_table"]).alias("row"), "prefix_table")
    return rows.mapInArrow(run, _with(rows, n_at=T.ArrayType(T.LongType()), n_fit=T.ArrayType(T.LongType()))).select("row.*", "n_at", "n_fit")
