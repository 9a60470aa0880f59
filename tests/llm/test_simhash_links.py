"""The near-dedup stage takes the links of the SimHash index, verified on the shingle sets."""

from __future__ import annotations

import numpy as np
from test_near_copies import jaccard, shingles

import corpus_pipeline
from evirank.llm import simhash


def test_links_of_fingerprints_are_verified_and_used(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(15):
        words = [f"w{x}" for x in rng.integers(0, 5000, 600)]
        near = list(words)
        near[300] = "other"
        texts += [" ".join(words), " ".join(near)]
    texts += [None, "", " \n", texts[0], "a b", "a c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.h: r.text for r in docs.select(simhash.text_hash().alias("h"), "text").collect()}
    fps = {h: simhash.fingerprint((t or "").encode(), 5)[0] for h, t in of.items()}
    want = {frozenset((a, b)) for a in of for b in of if a < b and (fps[a] ^ fps[b]).bit_count() <= 3 and jaccard(shingles(of[a]), shingles(of[b])) >= 0.8}
    got = {frozenset((r.src, r.dst)) for r in simhash.similar_links(docs).collect()}
    assert got <= want and len(got) >= 10
    # groups of at most two texts: the forest has all their links
    assert {p for p in want if all((of[h] or "").strip() for h in p)} <= got
    used, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: used.append(1) or links(*a))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 15 + 1 + 2 and used
