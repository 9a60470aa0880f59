"""Learned operators by held-out accuracy, archives by round trip, the pipeline against its stages."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evirank.llm import exact_dedup, langid, queries, toxicity, warc

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def made_up(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    bad = ["blorgish", "frumptious", "zagglepuff"]
    out = []
    for i in range(n):
        words, toxic = [rng.choice(clean) for _ in range(rng.randint(5, 120))], int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        out.append((i, " ".join(words), toxic))
    return out


def test_toxicity_finds_unseen_misspellings(spark, odd_docs, no_docs):
    rows = made_up(400, 1)
    model = toxicity.fit([t.encode() for _, t, _ in rows], [y for *_, y in rows])
    fresh = made_up(200, 1)[::2] + [(1000 + i, t.replace("blorgish", "blorgishh").replace("zagglepuff", "zaggleepuff"), y) for i, t, y in made_up(100, 2)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in fresh], "doc_id long, text string"), model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in fresh[:100]]) > 0.95
    score = model.words([b"blorgishh", b"zaggleepuff", b"abcd"])
    assert score[0] > score[2] and score[1] > score[2]
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(no_docs, model).count() == 0
    same = toxicity.fit([t.encode() for _, t, _ in rows[:60]], [y for *_, y in rows[:60]])
    again = toxicity.fit([t.encode() for _, t, _ in rows[:60]], [y for *_, y in rows[:60]])
    assert (same.direction == again.direction).all() and same.scale == again.scale
    for texts, labels in (([], []), ([None, b""], [1, 0]), ([b"a b"], [1])):
        assert 0 <= toxicity.fit(texts, labels).probability([(0.0, 0.0)])[0] <= 1


@tables
def test_toxicity_query(spark):
    got = queries.op2_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and (held.predicted == held.toxic).mean() > 0.88
    # accuracy alone says little where one label in eight is 1
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert ((toxic.predicted == 1).mean() + (clean.predicted == 0).mean()) / 2 > 0.8
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean() > 0.85
    assert set(got.columns) == {"doc_id", "held_out", "score", "predicted"}


@tables
def test_language_query(spark):
    got = queries.op5_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas()[["doc_id", "lang"]], on="doc_id")
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97 and got.score.between(0, 1).all()


def test_language_edges(spark, odd_docs, no_docs):
    profiles = langid.train(odd_docs)
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(odd_docs, profiles).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)} <= got
    assert langid.identify(no_docs, profiles).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    keys, counts = langid.grams("Ab ab-b".encode())
    assert counts.sum() == 5 + 8 + 5  # letters, pairs with edges, triples inside words


def brute_place(text, profiles, top):
    keys, counts = langid.grams(text.encode())
    mine = [k for k, _ in sorted(zip(keys.tolist(), counts.tolist(), strict=True), key=lambda x: (-x[1], x[0]))][:top]
    dist = {}
    for lang, p in profiles.items():
        at = {k: i for i, k in enumerate(p.tolist())}
        dist[lang] = sum(abs(at[k] - i) if k in at else top for i, k in enumerate(mine))
    return min(sorted(dist), key=dist.get)


def test_out_of_place_distance(spark):
    texts = {"x": "abc abd abe bcd aab " * 9, "y": "xyz xzz yzy zzx yxx " * 9}
    profiles = langid.train(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string"), top=30)
    model = langid.Classifier(profiles, top=30)
    for t in ("abd xz", "zzy", "aab bcd", "qq", "a x"):
        assert model(t.encode())[0] == brute_place(t, profiles, 30)


def test_archives_round_trip_and_salvage(spark, tmp_path):
    pages = [(1, "http://a/é b", "<p>one</p>"), (2, "u", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", "x" * 50_000 + "漢"), (5, "v", "x" * 50_000 + "漢"), (5, "v", "x" * 50_000 + "漢"), (None, "n", "<p>one</p>"), (6, "u", "WARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    written = warc.write_archives(df, f"file://{tmp_path}/w", file_bytes=200)
    got = warc.read_archives(spark, written).collect()
    assert {r.kind for r in got} == {"record"} and len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
        html = next((h or "") for i, _, h in pages if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == warc.payload_digest(html.encode())
        assert (r.record_type == "response") == (r.refers_to is None) and (r.payload is None) == (r.record_type == "revisit")
    assert by[1][0].record_type == "response" and by[2][0].refers_to == 1 and by[4][0].refers_to == 3 and by[None][0].refers_to == 1
    assert sorted(r.record_type for r in by[5]) == ["response", "revisit", "revisit"]
    empty = warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, empty).count() == 0
    records = [warc.record("response", i, "u", f"payload {i} ".encode() * 30) for i in range(6)]
    for pack in (lambda r: r, warc.gzip_member):
        members = [pack(r) for r in records]
        data = bytearray(b"".join(members))
        ends = np.cumsum([len(m) for m in members])
        assert len(warc.salvage(bytes(data))[0]) == 6 and warc.salvage(bytes(data))[1] == []
        for i in range(ends[0] + len(members[1]) // 2, ends[0] + len(members[1]) // 2 + 8):
            data[i] ^= 0x5A  # the second record is broken
        data[ends[3]:ends[3]] = b"junk between WARC/ and \x1f\x8b\x08 records"
        data = bytes(data)[: -len(members[5]) // 2]  # the last one is cut off
        good, gaps = warc.salvage(data)
        assert [int(r.headers["x-page-id"]) for r in good] == [0, 2, 3, 4]
        assert len(gaps) == 3 and sum(g.length for g in gaps) + sum(r.length for r in good) == len(data)
    mixed = warc.gzip_member(b"garbage" + records[0] + records[1])
    good, gaps = warc.salvage(mixed)
    assert len(good) == 2 and len(gaps) == 1 and warc.salvage(b"") == ([], [])


@tables
def test_warc_query_matches_pages(spark):
    got = queries.op3_warc(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and got.page_id.is_unique


@tables
def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        n.append(docs.count())
    assert n[0] > n[1] == n[2] > n[3] > n[4]
    exact = exact_dedup.exact_dedup(docs).where("group_size > 1").count()
    assert exact == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n[4] and last.agg(F.sum("taken")).first()[0] > 0


def test_pipeline_takes_odd_rows(spark, odd_docs, tmp_path):
    odd_docs.limit(0).select("doc_id", F.lit(1).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "plain text of one document")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, odd_docs.limit(0)):
        at = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{docs is odd_docs}{k}")
            stage(spark, at, str(tmp_path)).write.parquet(path)
            at = spark.read.parquet(path)
        assert (at.count() > 0) == (docs is odd_docs)
