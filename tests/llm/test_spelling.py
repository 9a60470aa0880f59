"""Spelling variants against a brute-force version."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evirank.llm import queries, spelling


def brute(docs: list[tuple], drop: int | None, min_length: int = 6, min_count: int = 5, ratio: int = 5) -> dict:
    count: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= min_length and n >= min_count}
    by = defaultdict(set)  # words that agree with one code point left out, or in one place
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
            by[(w[:i], w[i + 1 :])].add(w)
    near = defaultdict(set)
    for key, group in by.items():
        for a in group:
            near[a] |= {b for b in group if a != b and (isinstance(key, tuple) or key in (a, b))}
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x.encode()), default=None)
        out[w] = best if best is not None and words[best] >= ratio * n else None
    rows = {}
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows[w] = (out[w], root, n, len(near[w]), None if out[w] is None else words[out[w]])
    return rows


def rows_of(df) -> dict:
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.fixture(scope="module")
def word_docs():
    rng = np.random.default_rng(5)
    stems = ["letters", "bananas", "aaaaaaaa", "stra\u00dfe\u00e9n", "\u00c9cole\u00f7s", "mississippi", "zebraaa"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = stems[int(rng.integers(len(stems)) * rng.random())]
            for _ in range(int(rng.integers(0, 3) * (rng.random() < 0.4))):
                at, c = int(rng.integers(len(w))), "aez\u00e9\u00dfs"[int(rng.integers(6))]
                w = (w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:])[int(rng.integers(3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i if i % 17 else None, " ".join(words) + f" x{i}7abcdef, {i}"))
    return docs + [(1000, "mixtures " * 150 + "mixturesa " * 30 + "mixturesab " * 6)]


@pytest.mark.parametrize("drop", [None, 7, 199])
def test_variants_equal_brute_force(spark, word_docs, drop):
    docs = spark.createDataFrame([(*d, "mine", 3, 4) for d in word_docs], "doc_id long, text string, word string, n int, form int").repartition(5)
    want = brute(word_docs, drop)
    assert rows_of(spelling.variants(docs, drop_one_in=drop)) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())


def test_a_full_filter_loses_nothing(spark, word_docs, monkeypatch):
    monkeypatch.setattr(spelling, "LOG_FILTER", 8)
    monkeypatch.setattr(spelling, "LOG_BLOCK", 5)
    docs = spark.createDataFrame(word_docs, "doc_id long, text string")
    assert rows_of(spelling.variants(docs, drop_one_in=7)) == brute(word_docs, 7)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_neighbourhood_is_whole_and_distinct(monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    alphabet, word = "abn", "banaan"
    codes = spelling.letter_codes(alphabet)
    x = np.array([[alphabet.index(c) for c in word]], np.uint8)
    hash_of = lambda w: int(spelling.word_hashes(np.array([[alphabet.index(c) for c in w]], np.uint8), codes)[0])
    want = {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + c + word[i + 1 :] for i in range(6) for c in alphabet} | {word[:i] + c + word[i:] for i in range(7) for c in alphabet}
    got = [int(h) for _, _, hashes, distinct in spelling.neighbourhood(x, codes) for h in hashes[distinct]]
    assert sorted(got) == sorted(hash_of(w) for w in want - {word}) and len(set(got)) == len(got)


def test_roots_of_chains_and_trees(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(40)] + [(f"leaf{i}", "hub") for i in range(50)] + [("hub", "w020")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w040" for w, _ in forms}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(spelling.variants(odd_docs, 2, 2, 2)) == brute(rows, None, 2, 2, 2)
    monkeypatch.setattr(spelling, "LONG_TEXT", 1)
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert rows_of(spelling.variants(odd_docs, 2, 2, 2, 3)) == brute(rows, 3, 2, 2, 2)
    assert spelling.variants(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(odd_docs, ratio=1)


def test_op11_over_the_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op11_spelling_variants(spark, "/root/testdata/sf0.001")) == brute(docs, 199)
