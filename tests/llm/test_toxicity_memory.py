"""What a worker holds at once when it scores: the subwords of a part of the words, and the text of a row once."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from evirank.llm import toxicity


def test_words_are_scored_in_parts(monkeypatch):
    texts, labels = [f"good{i} day w{i % 7}".encode() for i in range(40)] + [f"bad{i} day fool".encode() for i in range(20)], [0] * 40 + [1] * 20
    model = toxicity.fit(texts, labels)
    words = [f"word{i} fool".encode() for i in range(95)]
    whole, most, plain = model.words(words), [], toxicity.subwords
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    monkeypatch.setattr(toxicity, "subwords", lambda part: most.append(len(part)) or plain(part))
    assert np.array_equal(model.words(words), whole) and max(most) == 10 and sum(most) == 95


def test_runs_are_found_in_parts_of_the_texts(monkeypatch):
    texts = [b" ".join(b"w%d" % ((i * j) % 23) for j in range(i % 9)) + (b" fool" if i % 3 == 0 else b"") for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    whole = toxicity.fit(texts, labels, window=2)
    monkeypatch.setattr(toxicity, "TOGETHER", 7)
    parts = toxicity.fit(texts, labels, window=2)
    assert np.array_equal(whole.direction, parts.direction) and whole.scale == parts.scale


def test_the_pipeline_sends_a_text_once(spark, odd_docs, tmp_path, monkeypatch):
    odd_docs.selectExpr("doc_id", "1 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    made, plain = [], toxicity.score
    monkeypatch.setattr(toxicity, "score", lambda *a, **b: made.append(plain(*a, **b)) or made[-1])
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Model(np.zeros(toxicity.BUCKETS), -1.0, 1))
    kept = corpus_pipeline.drop_toxic(spark, odd_docs, str(tmp_path))
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd_docs.collect())) and kept.schema == odd_docs.schema
    assert made[0].columns.count("text") == 1 and "text" not in made[0].schema["__row"].dataType.names
