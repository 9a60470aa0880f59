"""The packed search by blocks: limits a seed, keys in which pairs agree, and proteins that share their seeds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.operators import curation, similarity


def rows_of(spark, n: int, seed: int, dim: int = 128, labels: int = 3):
    rng = np.random.default_rng(seed)
    bits = (rng.random((n, dim)) < rng.uniform(0.02, 0.9, (n, 1))).astype(np.uint8)
    bits[n // 2] = bits[1]  # ties
    bits[3] = 0
    words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    data = [(i, int(i % labels), words[i].tolist(), int(bits[i].sum())) for i in range(n)]
    return bits, spark.createDataFrame(data, "id long, label long, words array<long>, bitcount int")


def scores(bits: np.ndarray) -> np.ndarray:
    b = bits.astype(np.int64)
    shared = b @ b.T
    union = b.sum(1)[:, None] + b.sum(1)[None] - shared
    return np.divide(shared, union, out=np.zeros(shared.shape), where=union > 0)


@pytest.mark.parametrize(("threshold", "maximum", "block"), [(0.3, None, 16_384), (0.3, 0.7, 7), (0.95, None, 7), (1.0, None, 16_384), (0.01, None, 50)])
def test_pairs_and_the_best_of_each_seed(spark, monkeypatch, threshold, maximum, block):
    monkeypatch.setattr(similarity, "PACKED_BLOCK", block)
    bits, df = rows_of(spark, 120, 5)
    want, top = {}, {}
    for (i, j), v in np.ndenumerate(scores(bits)):
        if v >= threshold and (maximum is None or v <= maximum):
            want[i, j] = v
            top.setdefault(i, []).append((-v, j))
    sides = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id")
    assert {(r.query_id, r.target_id): r.tanimoto for r in similarity.tanimoto_join(*sides, threshold, maximum).collect()} == want
    got = similarity.tanimoto_join(*sides, threshold, maximum, per_query=3).collect()
    assert {(r.query_id, r.target_id) for r in got} == {(i, j) for i, found in top.items() for _, j in sorted(found)[:3]} and len(got) == len({(r.query_id, r.target_id) for r in got})


def test_agreement_other_ids_and_vectors_of_several_lengths(spark):
    bits, df = rows_of(spark, 90, 6)
    sides = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "target_id").unionByName(spark.createDataFrame([(1000, 0, [-1], 64), (1001, 0, [None, 1], 1), (1002, None, [-1, -1], 128)], "target_id long, label long, words array<long>, bitcount int"))
    got = similarity.tanimoto_join(*sides, 0.2, within=["label"], other_ids=True).collect()
    assert {(r.query_id, r.target_id): r.tanimoto for r in got} == {(i, j): v for (i, j), v in np.ndenumerate(scores(bits)) if v >= 0.2 and i % 3 == j % 3 and i != j}


def test_max_pairwise_and_curation(spark):
    bits, df = rows_of(spark, 90, 7)
    apart = spark.createDataFrame([(900, 8, [1, 0], 1), (901, 8, [2, 0], 1), (902, 9, [1, 0], 1), (902, 9, [1, 0], 1)], df.schema)
    v = scores(bits)
    want = {g: max(v[i, j] for i in range(g, 90, 3) for j in range(g, 90, 3) if i < j) for g in range(3)} | {8: 0.0}
    assert {r.label: r.max_tanimoto for r in similarity.max_pairwise(df.unionByName(apart), "label").collect()} == want
    of = df.withColumnsRenamed({"id": "chem_comp_id", "label": "pfam_id"}).withColumn("uniprot_id", F.col("chem_comp_id") % 4)
    curated, _ = curation.similarity_curation(of.where("chem_comp_id % 2 = 1"), of.where("chem_comp_id % 2 = 0"), 0.6)
    assert {r.chem_comp_id for r in curated.collect()} == {i for i in range(1, 90, 2) if any(v[i, j] >= 0.6 for j in range(0, 90, 2) if i % 3 == j % 3)}


def test_proteins_that_share_seeds_meet_no_more_hits_than_they_keep(spark):
    """600 proteins of 20 seeds that 2,000 targets are like: all hits of all proteins would be 24 million rows."""
    words = [((1 << 62) - 1) ^ (1 << (i % 60)) for i in range(2000)]
    targets = spark.createDataFrame([(i, [w], 61) for i, w in enumerate(words)], "target_id long, words array<long>, bitcount int")
    seeds = targets.where("target_id < 20").withColumnRenamed("target_id", "query_id")
    of = spark.range(600).select(F.when(F.col("id") > 0, F.col("id")).alias("uniprot_id"))
    proteins = of.crossJoin(seeds).where("coalesce(uniprot_id, 0) % 2 = 0 or query_id >= 10")
    got = similarity.similarity_search(proteins, targets, 0.9, top=25)
    by = {}
    for r in got.collect():
        by.setdefault(r.uniprot_id, []).append((r.target_id, r.query_id, r.tanimoto))
    assert set(by) == {None, *range(1, 600)}
    # the targets that are the seed's copies, then, for the first seed only
    for p, low in ((None, 0), (1, 10), (2, 0), (599, 10)):
        assert sorted(by[p]) == [(t, low, 1.0) for t in range(low, 25 * 60, 60)]
    rows = [n for n in ("Join", "Window") if n in got._jdf.queryExecution().optimizedPlan().toString()]
    assert rows == ["Join"]  # ranked before the proteins are met
