"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import batches, bounded_sample, bytes_of

#: The word boundary in an n-gram; no letter has this code.
EDGE = 1


@cache
def letters() -> np.ndarray:
    """Code point to its lower-cased letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: bytes | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to ``longest``-grams (at most 3) of a text's words, edges marked, and their counts.
    A gram is up to three code points of 21 bits in one integer."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    low = letters()[points].astype(np.uint64)
    if not low.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = np.concatenate(([0], low, [0])).astype(np.uint64)
    # runs of non-letters become one edge
    stay = (low[1:] > 0) | (low[:-1] > 0)
    low = low[1:][stay]
    low = np.concatenate(([EDGE], np.where(low == 0, EDGE, low))).astype(np.uint64)
    keys = [low[low != EDGE]]
    if longest >= 2:
        two = (low[:-1] << np.uint64(21)) | low[1:]
        keys.append(two)
    if longest >= 3:
        inside = low[1:-1] != EDGE
        keys.append((((low[:-2] << np.uint64(42)) | (low[1:-1] << np.uint64(21))) | low[2:])[inside])
    return np.unique(np.concatenate(keys), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by key."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:top]


def train(labelled: DataFrame, top: int = 400, max_docs: int = 8000, max_bytes: int = 64 << 20, longest: int = 3) -> dict[str, np.ndarray]:
    """Language to profile, from columns doc_id, text and lang (null langs are left out).

    At most ``max_docs`` labelled rows and ``max_bytes`` of text are used, chosen by a hash of their doc_id.
    Counts are summed with map-side combine per language and n-gram.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    chosen = bounded_sample(rows, "doc_id", max_docs, max_bytes).select(F.col("text").cast("string"), "lang")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            by: dict[str, list] = {}
            for text, lang in zip(bytes_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text or b"")
            for lang, texts in by.items():
                keys, counts = grams(b" ".join(texts), longest)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counted = chosen.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= top)
    out: dict[str, list] = {}
    for r in best.orderBy("lang", "r").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Classifier:
    def __init__(self, profiles: dict[str, np.ndarray], top: int = 400, longest: int = 3):
        self.langs, self.top, self.longest = sorted(profiles), top, longest
        self.keys = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[x])] = np.arange(len(profiles[x]))

    def __call__(self, text: bytes | None) -> tuple[str, float]:
        """The language of least out-of-place distance (ties: first in sorted order), and a score: how far
        the runner-up is behind, from 0.5 (equal) to 1, as a share of both.  'und' (score 0) for no letter."""
        keys, counts = grams(text, self.longest)
        if not len(keys) or not self.langs:
            return "und", 0.0
        mine = ranked(keys, counts, self.top)
        place = np.searchsorted(self.keys, mine)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == mine[known]
        ranks = self.ranks[:, np.where(known, place, len(self.keys))]
        # profiles are longer than a short text's: ranks are compared on the scale of the text's own
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(mine))))
        total = away.sum(1)
        order = np.argsort(total, kind="stable")
        if len(order) == 1:
            return self.langs[0], 1.0
        near = self.top * len(mine) - total[order[:2]] + 1.0
        return self.langs[order[0]], float(near[0] / near.sum())


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[Column | str] = (), top: int = 400, longest: int = 3) -> DataFrame:
    """doc_id, lang_pred, score, and the columns ``keep``: one row per input row, over the whole text.

    Null texts and texts without a letter: 'und' with score 0.  Repeated rows are answered each; an empty
    table gives an empty result; other columns are ignored.
    """
    profiles_ = profiles
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    kept = [c for c in source.columns[2:]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles_, top, longest)
        for b in batches(parts):
            got = [model(t) for t in bytes_of(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), *(b.column(2 + i) for i in range(len(kept)))],
                ["doc_id", "lang_pred", "score", *kept],
            )

    return source.mapInArrow(run, StructType([source.schema[0], *StructType.fromDDL("lang_pred string, score double").fields, *source.schema.fields[2:]]))
