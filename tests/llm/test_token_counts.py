"""Prefix counts against the library: every prefix of short texts, whole long texts, stored tables."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from evirank.llm import queries, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as spec:
    MODEL = token_counts.Prefixes(spec.read())


def true_count(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def check_all(text: str) -> None:
    want = [n for n in (len(e.ids) for e in LIBRARY.encode_batch([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False))]
    assert next(MODEL.counts([text])).tolist() == want, text
    pair = list(MODEL.counts(["x" + text, text]))
    assert pair[1].tolist() == want and len(pair[0]) == len(text) + 1


@pytest.mark.parametrize("text", [
    "", "a", "Hello world, it's we're they'll I've 'r 're''ve '", "a  b\n\n c \n\n\n  d   ", "  lead", "\t\tx\r\n y", "don't 'll", "x" * 300 + " " * 200 + "y",
    "!!'re ''s 'sun", "Ünïcödé straße 漢字かな 🙂🙂👩‍👩‍👧 é    x", "12345 67.89 ½ ²", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> !!<|endoftext|>", "<|endoftext", "\x1c\x1d x\x85y",
    "՘࢏ a\U00010940b 1౜2 ꟎q", "aaaaaaaaaa bbbbb" * 20, "\n" * 70 + "x", "ab　　cd  　e",
])
def test_every_prefix(text):
    check_all(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab tTheing'relvsmd \n\t .,!?<|endoftx>0123éß漢🙂́ "), max_size=60))
def test_every_prefix_of_random_text(text):
    check_all(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_every_prefix_of_any_text(text):
    check_all(text)


def test_forgotten_pieces_are_made_again(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "SHORT", 4)
    monkeypatch.setattr(token_counts, "AT_ONCE", 10)
    with open(PATH, encoding="utf-8") as f:
        small = token_counts.Prefixes(f.read())
    texts = ["some words, and   more  words\n\n\n", "", "x" * 300, " " * 90 + "é" * 90 + " " * 90 + "z", "and again some words"] * 3
    for text, counts in small.each(texts):
        assert counts.tolist() == [true_count(text[:i]) for i in range(1, len(text) + 1)]


def test_fit_is_the_longest_prefix():
    rng = np.random.default_rng(1)
    for _ in range(100):
        counts = np.cumsum(rng.integers(-1, 3, rng.integers(0, 30))).clip(1).astype(np.int32)
        for budget in (0, 1, 5, 100):
            assert token_counts.fit(counts, budget) == max(i for i in range(len(counts) + 1) if i == 0 or counts[i - 1] <= budget)
    for counts in (np.array([], np.int32), np.array([1, 500, 3], np.int32), np.array([1, 90_000, 2], np.int32)):
        assert token_counts.unpacked(token_counts.packed(counts)).tolist() == counts.tolist()


def test_rows_and_odd_texts(spark, odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "'kept' as n_bytes", "'mine' as row", "'x' as `a.b`")
    got = token_counts.count_tokens(docs, PATH, 5, [docs.doc_id, docs.row, docs["`a.b`"]])
    assert got.columns == ["doc_id", "row", "a.b", "n_bytes", "n_tokens", "over_limit", "n_fit"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = []
    for r in odd_docs.collect():
        n = true_count(r.text or "")
        fits = max(i for i in range(min(len(r.text or ""), 60) + 1) if true_count((r.text or "")[:i]) <= 5)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 5, fits))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.n_fit) for r in got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(no_docs, PATH, 5, [no_docs.doc_id]).count() == 0
    assert token_counts.count_tokens(docs, PATH, 5).where("n_tokens > 5").count() == sum(w[3] for w in want)


def test_stored_tables_answer_without_the_text(spark, odd_docs, no_docs):
    stored = token_counts.prefix_tables(odd_docs, PATH, [odd_docs.doc_id, odd_docs.text.alias("t")])
    for r in token_counts.answer(stored, [0, 1, 7, 10**9], [0, 3, 10**9]).collect():
        text = r.t or ""
        assert r.n_at == [0, true_count(text[:1]), true_count(text[:7]), true_count(text)]
        assert r.n_fit[0] == 0 and r.n_fit[2] == len(text) and true_count(text[: r.n_fit[1]]) <= 3
    assert token_counts.answer(token_counts.prefix_tables(no_docs, PATH), [1], [1]).count() == 0


def test_op13_counts_whole_texts(spark):
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for (doc_id, text), e in zip(docs, LIBRARY.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), len(e.ids), len(e.ids) > 1024)
        assert r.n_fit == len(text or "") if not r.over_limit else true_count(text[: r.n_fit]) <= 1024 < true_count(text[: r.n_fit + 1])
