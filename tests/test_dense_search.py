"""Dense search in blocks against NumPy, with and without pruning, and the common search over both metrics."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.operators import similarity


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 12)) for c in centres])
    x[7] = 0
    x[9] = x[8]
    return x


def tables(spark, x):
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "target_id long, vec array<double>").repartition(3)
    s = t.where("target_id % 5 = 0 or target_id in (7, 8)").withColumnRenamed("target_id", "query_id")
    return s.union(spark.createDataFrame([(None, x[0].tolist())], "query_id long, vec array<double>")), t


@pytest.mark.parametrize("blocks", [{}, {"seed_block": 7, "target_block": 30, "cells": 5}, {"seed_block": 1000, "target_block": 9, "cells": 64}])
@pytest.mark.parametrize(("threshold", "maximum", "per_query"), [(0.8, None, None), (0.2, 0.97, 4), (-1.0, None, 3)])
def test_blocks_equal_numpy(spark, clustered, blocks, threshold, maximum, per_query):
    x = clustered
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = u @ u.T
    seeds, targets = tables(spark, x)
    got = {(r.query_id, r.target_id): r.similarity for r in similarity.cosine_join(seeds, targets, threshold, maximum, per_query, **blocks).collect()}
    want = {}
    for q in [i for i in range(len(x)) if i % 5 == 0 or i in (7, 8)]:
        ok = [t for t in np.lexsort((np.arange(len(x)), -np.round(c[q], 12))) if c[q, t] >= threshold and (maximum is None or c[q, t] <= maximum)]
        want |= {(q, int(t)): c[q, t] for t in ok[:per_query]}
    near_ties = {k for k in got.keys() ^ want.keys()}
    assert all(min(abs(c[q, t] - c[q, o]) for o in range(len(x)) if o != t) < 1e-9 for q, t in near_ties)
    assert {k: got[k] for k in got.keys() & want.keys()} == pytest.approx({k: want[k] for k in got.keys() & want.keys()})
    assert len(got) == len(want)


def test_far_blocks_are_left_out(spark, clustered):
    x = clustered[[i for i in range(len(clustered)) if i != 7]]
    seeds, targets = tables(spark, x)
    pivots = similarity._units(x[::20])
    s, t = similarity._cells(seeds, "query_id", pivots, 1000), similarity._cells(targets, "target_id", pivots, 1000)
    every = similarity.block_pairs(s, t, pivots, -1.0).count()
    near = similarity.block_pairs(s, t, pivots, 0.95).count()
    assert every == s.select("cell").distinct().count() * t.select("cell").distinct().count() and near < every / 3


def test_empty_sides_and_many_seeds(spark, clustered):
    seeds, targets = tables(spark, clustered)
    assert similarity.cosine_join(seeds.limit(0), targets).count() == 0 and similarity.cosine_join(seeds, targets.limit(0)).count() == 0
    many = spark.range(100_300).select(F.col("id").alias("query_id"), F.array((F.col("id") % 7 - 3).cast("double"), F.lit(1.0)).alias("vec"))
    few = spark.createDataFrame([(i, [float(i - 1), 2.0]) for i in range(3)], "target_id int, vec array<double>")
    assert similarity.cosine_join(many, few, per_query=1, seed_block=8192).count() == 100_300


def test_one_search_for_both_metrics(spark, clustered):
    seeds, targets = tables(spark, clustered)
    got = similarity.search(seeds, targets, "cosine", 0.5, per_query=3, top=20).collect()
    assert len(got) == 20 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    bits = spark.createDataFrame([(i, [3 << i], 2) for i in range(6)], "target_id int, words array<long>, bitcount int")
    found = similarity.search(bits.withColumnRenamed("target_id", "query_id"), bits, "tanimoto", 0.3, 0.9).collect()
    assert {(r.query_id, r.target_id) for r in found} == {(i, j) for i in range(6) for j in range(6) if abs(i - j) == 1}
    for metric, a, b in (("cosine", bits, targets), ("tanimoto", seeds, bits), ("dice", bits, bits)):
        with pytest.raises(ValueError):
            similarity.search(a, b, metric, 0.5)
