"""run() on the smallest tables against a plain Python version of all five stages."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from test_llm_text_ops import hits_brute, lines_brute, union_find
from test_near_copies import jaccard, shingles

import corpus_pipeline
from evirank.llm import mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, queries.training_labels(spark, SF))
    rows = [r for r in docs.collect() if model.probability([model.evidence(model.words(toxicity.words_of((r.text or "").encode())))])[0] < 0.5]
    texts = {i: t for i, _, _, t in lines_brute(rows)}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    root = union_find(sets, near)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r.doc_id: r.source for r in rows if root[r.doc_id] == r.doc_id and not hits_brute(texts[r.doc_id], items)[1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept) and 0 < len(kept) < docs.count()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in kept}
    names = sorted(set(kept.values()), key=lambda s: (s is None, s or ""))
    per = [sum(n for i, n in sizes.items() if kept[i] == s) for s in names]
    target = mixing.targets_of(per, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for s, n, t in zip(names, per, target, strict=True):
        mine = [got[i] for i in kept if kept[i] == s]
        assert all(r.size == sizes[r.doc_id] and r.source_size == n and r.target == pytest.approx(t) and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= max(2, 0.005 * t)
