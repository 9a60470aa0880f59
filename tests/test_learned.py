"""Learned search on a grid of blocks against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.operators import learned, scoring

DIM = 100


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    b = (rng.random((150, DIM)) < 0.3).astype(np.uint8)
    b[7], b[9] = b[3], b[3]
    padded = np.zeros((150, 128), np.uint8)
    padded[:, :DIM] = b
    return b.astype(float), np.packbits(padded, axis=1, bitorder="little").view(np.int64)


def networks():
    return {p: scoring.Network.random(DIM, (8, 4), seed=i) for i, p in enumerate(["PF1", "PF2", "PF3"])}


def expected(b, seeds, threshold, per_seed):
    """(pfam, query): its best targets and scores"""
    nets, out = networks(), {}
    for p, q in {(p, q) for _, p, q in seeds if p in nets}:
        s = np.round(nets[p](b + b[q]), 9)
        ok = [t for t in np.lexsort((np.arange(len(s)), -s)) if s[t] >= threshold][:per_seed]
        out[p, q] = [(int(t), s[t]) for t in ok]
    return out


@pytest.mark.parametrize("blocks", [{}, {"seed_block": 3, "target_block": 16, "pieces": 2, "rows_at_once": 5}, {"seed_block": 1, "target_block": 1000, "pieces": 1}])
def test_grid_equals_numpy(spark, rows, blocks):
    b, words = rows
    seeds = [(f"u{i % 4}", ["PF1", "PF2", "none", "PF3", "PF1"][i % 5], i) for i in range(30)] + [("u9", "PF1", 0), ("u0", "PF1", 0)]
    df = spark.createDataFrame([(u, p, q, words[q].tolist()) for u, p, q in seeds] + [("u1", None, 1, [1, 2]), ("u1", "PF1", None, [1, 2])], "uniprot_id string, pfam_id string, query_id long, words array<long>")
    targets = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "target_id long, words array<long>").repartition(3)
    want = expected(b, seeds, 0.5, 7)
    got = scoring.score_blocks(df.drop("uniprot_id"), targets, scoring.model_table(spark, networks()), DIM, 0.5, 7, **blocks).collect()
    assert {(r.pfam_id, r.query_id, r.target_id) for r in got} == {(p, q, t) for (p, q), ts in want.items() for t, _ in ts}
    for r in got:
        assert r.bsi_score == pytest.approx(dict(want[r.pfam_id, r.query_id])[r.target_id])
    best = {}
    for u, p, q in sorted(set(seeds), key=lambda x: x[2]):
        for t, s in want.get((p, q), []):
            if (u, t) not in best or s > best[u, t][0]:
                best[u, t] = (s, p, q)
    mine = {u: sorted(((-s, q, t) for (v, t), (s, _, q) in best.items() if v == u))[:10] for u in {u for u, _ in best}}
    found = scoring.learned_scores(df, targets, networks(), DIM, 0.5, 7, 10, **blocks).collect()
    assert {(r.uniprot_id, r.query_id, r.target_id) for r in found} == {(u, q, t) for u, hits in mine.items() for _, q, t in hits}


def test_no_seed_limit_and_no_rows_on_the_driver(spark, rows):
    """More seeds than the former bound of 100,000, a third of them of one domain."""
    b, words = rows
    n = 100_500
    base = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "i long, words array<long>")
    seeds = spark.range(n).withColumn("i", F.col("id") % 150).join(F.broadcast(base), "i").select(F.when(F.col("id") % 3 == 0, "PF1").otherwise("PF2").alias("pfam_id"), F.col("id").alias("query_id"), "words")
    targets = base.where("i < 5").withColumnRenamed("i", "target_id")
    got = scoring.score_blocks(seeds, targets, scoring.model_table(spark, networks()), DIM, 0.0, 1, seed_block=2048)
    nets = networks()
    score = {p: np.array([np.round(nets[p](b[:5] + q), 9) for q in b]) for p in ("PF1", "PF2")}
    sums = {p: sum(float(score[p][i % 150].max()) for i in range(n) if (i % 3 == 0) == (p == "PF1")) for p in score}
    found = {r.pfam_id: (r.n, r.s) for r in got.groupBy("pfam_id").agg(F.count("*").alias("n"), F.sum("bsi_score").alias("s")).collect()}
    assert {p: x[0] for p, x in found.items()} == {"PF1": n // 3, "PF2": n - n // 3}
    assert {p: x[1] for p, x in found.items()} == pytest.approx(sums)


def test_empty_sides(spark, rows):
    _, words = rows
    seeds = spark.createDataFrame([("u", "PF1", 1, words[1].tolist())], "uniprot_id string, pfam_id string, query_id long, words array<long>")
    targets = spark.createDataFrame([(1, words[1].tolist())], "target_id long, words array<long>")
    for s, t, m in ((seeds.limit(0), targets, networks()), (seeds, targets.limit(0), networks()), (seeds, targets, {"PF2": networks()["PF2"]})):
        assert scoring.learned_scores(s, t, m, DIM, 0.0).count() == 0


def test_search_takes_the_best_domain_and_distinct_compounds(spark, rows):
    b, words = rows
    domains = spark.createDataFrame([("a", "PF1"), ("a", "PF2"), ("b", "PF9"), ("c", "PF3"), ("c", "PF2"), (None, "PF1"), ("d", "PF1")], "uniprot_id string, pfam_id string")
    registry = spark.createDataFrame([("PF1", 0.5, "trained"), ("PF2", 0.9, "failed"), ("PF3", None, "trained"), ("PF2", 0.1, "trained")], "pfam_id string, val_pr_auc double, status string")
    known = spark.createDataFrame([("a", "L1", 5.0), ("a", "L2", 6.0), ("a", "absent", 1.0), ("b", "L1", 1.0), ("c", "L3", None)], "uniprot_id string, chem_comp_id string, pchembl double")
    vectors = spark.createDataFrame([(f"L{i}", words[i].tolist(), int(b[i].sum())) for i in range(1, 4)], "chem_comp_id string, words array<long>, bitcount int")
    seeds = learned.model_seeds(domains, registry, known, vectors, None)
    assert {(r.uniprot_id, r.pfam_id, r.query_id) for r in seeds.collect()} == {("a", "PF1", "L1"), ("a", "PF1", "L2"), ("c", "PF2", "L3")}
    targets = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "target_id long, words array<long>")
    compounds = spark.createDataFrame([(i, f"C{i % 40}", "s") for i in range(150)], "lig_idx long, chem_comp_id string, smiles string")
    table = scoring.model_table(spark, networks())
    got = learned.learned_search(domains, registry, table, known, vectors, targets, compounds, DIM, 0.5, None, top=20, prefix="Z").collect()
    nets = networks()
    for u, p, qs in (("a", "PF1", (1, 2)), ("c", "PF2", (3,))):
        best = {}
        for q in qs:
            for t, s in enumerate(np.round(nets[p](b + b[q]), 9)):
                if s >= 0.5:
                    best[f"ZC{t % 40}"] = min(best.get(f"ZC{t % 40}", (1,)), (-s, f"L{q}"))
        want = {(c, q) for _, q, c in sorted((s, q, c) for c, (s, q) in best.items())[:20]}
        assert {(r.chem_comp_id, r.query_id) for r in got if r.uniprot_id == u} == want
        assert {r.pfam_id for r in got if r.uniprot_id == u} <= {p}
    assert {r.uniprot_id for r in got} == {"a", "c"}
