"""near_copies() against the Jaccard similarity of all pairs."""

from __future__ import annotations

import os

import numpy as np
import pytest
from test_llm_text_ops import hits_brute, lines_brute, union_find

import corpus_pipeline
from evirank.llm import near_copies, queries, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(docs, similarity=0.8):
    sets = {i: shingles(t) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= similarity]
    return union_find(sets, links), links


def text_pairs(n, rng, changes):
    """Pairs of texts of 200 words; the second has so many words changed."""
    out = []
    for i in range(n):
        words = [f"w{int(x)}" for x in rng.integers(0, 10**6, 200)]
        copy = list(words)
        for at in rng.choice(np.arange(2, 198, 6), changes, replace=False):
            copy[int(at)] = f"new{i}x{at}"
        out += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return out


def test_every_pair_from_0_8_is_found(spark):
    docs = text_pairs(120, np.random.default_rng(1), 4)  # 20 of 196 shingles changed: 0.81
    want, links = brute(docs)
    assert len(links) == 120
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 240, 2))


def family(n, rng, own, first):
    """Texts of 200 words that differ from one template in ``own`` places each."""
    base = [f"t{int(x)}" for x in rng.integers(0, 10**6, 200)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.choice(np.arange(2, 198, 6), own, replace=False):
            copy[int(at)] = f"own{first + i}x{at}"
        out.append((first + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("part", [512, 16])
def test_hot_lists_are_compared_to_the_end(spark, monkeypatch, part):
    """Also when a list is dealt into many parts."""
    monkeypatch.setattr(near_copies, "PART", part)
    rng = np.random.default_rng(3)
    docs = family(150, rng, 1, 0)  # most pairs are near copies: one group beyond what a small list holds
    docs += [(200 + i, t) for i, (_, t) in enumerate(family(60, rng, 2, 0))]
    docs += [(300, None), (301, " "), (302, "Two words"), (303, "two  words"), (302, "two words")]
    want, _ = brute([d for d in docs if d != (302, "two words")])
    got = near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in got if r.stays and r.doc_id != 302} == set(want.values()) - {302}


def test_no_text_is_lost(spark, odd_docs, no_docs):
    """Null and repeated ids, repeated rows, columns of odd names: texts like no other stay."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(40)) for x in "tuv")
    spec = "doc_id long, text string, `my col: x` int, `a.b` string, __row int"
    rows = [(1, t, 1, "a", 1), (None, t, 2, "b", 1), (None, u, 3, "c", 1), (5, t, 4, "d", 1), (5, v, 5, "e", 1), (1, t, 1, "a", 2), (None, u, 6, None, None), (7, None, 7, "g", 1), (8, " ", 8, "h", 1)]
    docs = spark.createDataFrame(rows, spec).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r[0], r[1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, t), (None, u), (5, v), (7, None)], key=str)
    benchmark = spark.createDataFrame([(1, " ".join(u.split()[5:25])), (2, None)], "item_id long, text string")
    clean = corpus_pipeline.decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r[2] for r in clean.collect()) == [1, 1, 2, 4, 5, 7, 8]
    assert corpus_pipeline.decontaminate.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    lines = corpus_pipeline.drop_lines(spark, docs, "")
    assert lines.columns == docs.columns and sorted(map(str, lines.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.drop_near_copies(spark, no_docs, "").count() == corpus_pipeline.drop_lines(spark, no_docs, "").count() == 0
    assert corpus_pipeline.drop_near_copies(spark, odd_docs, "").columns == odd_docs.columns


def test_recall_over_all_pairs(spark):
    """Planted copies between 0.8 and 1: at least 0.98 of the pairs are in one group, and no pair below 0.8."""
    rng, docs = np.random.default_rng(9), []
    for changes in (1, 2, 3, 4):
        docs += [(len(docs) + k, t) for k, (_, t) in enumerate(text_pairs(100, rng, changes))]
    want, links = brute(docs)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(links) == 400 and sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    assert all(want[a] == want[b] for a, b in got.items())


def test_shingle_sets_and_parts():
    assert near_copies.shingle_set(None, 5).tolist() == near_copies.shingle_set(b" \n", 5).tolist()
    assert len(near_copies.shingle_set(b"a b c d e f", 5)) == 2 and len(near_copies.shingle_set(b"a b", 5)) == 1
    assert near_copies.alike(np.arange(8), np.arange(10), 0.8) and not near_copies.alike(np.arange(7), np.arange(10), 0.8)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_keeps_what_all_pairs_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, queries.training_labels(spark, SF))
    rows = [r for r in docs.collect() if model.probability([model.evidence(model.words(toxicity.words_of((r.text or "").encode())))])[0] < 0.5]
    texts = {i: t for i, _, _, t in lines_brute(rows)}
    root, _ = brute(list(texts.items()))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {i for i, t in texts.items() if root[i] == i and not hits_brute(t, items)[1]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept


def test_alike_below_0_8_stays(spark):
    docs = family(80, np.random.default_rng(5), 4, 0)  # mutual similarity 0.66 to 0.79
    want, links = brute(docs)
    assert not links
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(want)
