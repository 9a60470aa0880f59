from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.operators import candidates, compounds, curation, known, results, scoring, selection, similarity

TIE = ["row"]


@pytest.fixture(scope="module")
def hits(spark):
    rows = [
        ("q1", "p1", 95.0, 95, 100, 100, 1e-9, 200.0, 1),
        ("q1", "p1", 96.0, 95, 100, 100, 1e-9, 200.0, 2),  # tie in score, better identity
        ("q1", "p2", 90.0, 90, 100, 100, 1e-5, 150.0, 3),  # on every limit
        ("q1", "p3", 50.0, 120, 100, 100, 1e-3, 90.0, 4),  # coverage above 1
        ("q2", "p3", 99.0, 99, 100, 0, 1e-9, 80.0, 5),  # no subject length
    ]
    return spark.createDataFrame(rows, "qseqid string, sseqid string, pident double, length int, qlen int, slen int, evalue double, bitscore double, row int")


def test_strict_limits_are_inclusive(hits):
    got = candidates.strict_hits(hits)
    assert sorted(r.row for r in got.collect()) == [1, 2, 3]


def test_one_row_per_pair_with_ties_broken(hits):
    got = {(r.qseqid, r.sseqid): r.pident for r in candidates.sequence_candidates(hits, TIE).collect()}
    assert got == {("q1", "p1"): 96.0, ("q1", "p2"): 90.0}
    # the limit counts hit rows before pairs
    assert candidates.sequence_candidates(hits, TIE, max_hits=2).count() == 1
    assert candidates.sequence_candidates(hits, TIE, max_hits=0).count() == 0


def test_nearest_k_needs_a_shared_domain(spark, hits):
    best = candidates.best_hit_per_pair(hits, TIE)
    pool = candidates.nearest_pool(best, candidates.sequence_candidates(hits, TIE))
    assert {r.sseqid for r in pool.collect()} == {"p3"}
    domains = spark.createDataFrame([("p3", "PF1"), ("p3", "PF2"), ("p9", "PF1")], "uniprot_id string, pfam_id string")
    found = spark.createDataFrame([("q1", "PF1.20", 9.0, 1e-9), ("q1", "PF2.3", 9.0, 1e-9)], "qseqid string, pfam_acc string, dom_score double, dom_i_evalue double")
    near = candidates.nearest_k(pool, domains, found)
    assert [(r.qseqid, r.sseqid) for r in near.collect()] == [("q1", "p3")]
    counted = candidates.with_shared_domains(candidates.combine(near), domains, found)
    assert counted.first().n_shared_domains == 2


def test_domain_candidates_rank_hits_first(spark, hits):
    best = candidates.best_hit_per_pair(hits, TIE)
    domains = spark.createDataFrame([(f"p{i}", "PF1") for i in range(30)], "uniprot_id string, pfam_id string")
    found = spark.createDataFrame([("q1", "PF1", 9.0, 1e-9), ("q1", "PF1", 12.0, 1e-7)], "qseqid string, pfam_id string, dom_score double, dom_i_evalue double")
    top = candidates.domain_top_n(found, domains, best, 4)
    assert sorted(r.sseqid for r in top.collect()) == ["p0", "p1", "p2", "p3"]
    row = candidates.domain_candidates(top).where("sseqid = 'p1'").first()
    assert (row.best_domain_score, row.best_domain_evalue, row.has_blast_hit) == (12.0, 1e-9, True)
    with pytest.raises(ValueError):
        candidates.domain_top_n(found, domains, best, 0)


def test_known_keeps_first_non_null_in_row_order(spark):
    rows = [("u", "l", "PF2", "pdb", "B", None, None, 2), ("u", "l", "PF2", "pdb", "A", 7.0, "m2", 3), ("u", "l", "PF2", "pdb", "B", 6.0, "m3", 4), ("u", "l", "PF1", "pdb", "C", None, None, 1), ("u", "l", None, "pdb", "Z", 9.0, "x", 0)]
    binding = spark.createDataFrame(rows, "uniprot_id string, chem_comp_id string, pfam_id string, source string, pdb_id string, pchembl double, mechanism string, ord int")
    row = known.known_binding(binding, spark.createDataFrame([("l", "CC"), ("x", None)], "chem_comp_id string, smiles string")).first()
    assert (row.binding_sites, row.pdb_ids, row.pchembl, row.mechanism, row.smiles) == (["PF1", "PF2"], ["C", "B", "A"], 7.0, "m2", "CC")


def test_summary_has_rows_for_queries_without_results(spark):
    queries = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "qseqid string")
    ranking = spark.createDataFrame([("q1", "p", "sequence")], "qseqid string, sseqid string, search_type string")
    ligands = spark.createDataFrame([("q1", "l", "domain")], "qseqid string, chem_comp_id string, search_type string")
    got = results.summary(queries, ranking, ligands, ligands.limit(0))
    assert got.columns == results.SUMMARY.names
    assert sorted(tuple(r)[:3] for r in got.collect()) == [("q1", 1, 0), ("q2", 0, 0), ("q2", 0, 0)]


def brute(words, bits, i, j):
    s = int(np.bitwise_count(words[i] & words[j]).sum())
    u = int(bits[i] + bits[j] - s)
    return s / u if u else 0.0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    b = (rng.random((40, 167)) < 0.3).astype(np.uint8)
    b[5] = b[4]
    b[6] = 0
    padded = np.zeros((40, 192), np.uint8)
    padded[:, :167] = b
    words = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    return b, words, b.sum(1).astype(np.int64)


def test_packing_and_tanimoto(spark, vectors):
    b, words, bits = vectors
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(b)], "id int, b array<int>")
    packed = df.select("id", similarity.packed(F.col("b")).alias("words")).withColumn("bitcount", similarity.bitcount(F.col("words")))
    for r in packed.collect():
        assert np.array(r.words, np.int64).view(np.uint64).tolist() == words[r.id].tolist() and r.bitcount == bits[r.id]
    t = 0.2
    got = similarity.tanimoto_join(packed.withColumnRenamed("id", "query_id"), packed.withColumnRenamed("id", "target_id"), t)
    want = {(i, j): brute(words, bits, i, j) for i in range(40) for j in range(40)}
    want = {k: v for k, v in want.items() if v >= t}
    assert {(r.query_id, r.target_id): r.tanimoto for r in got.collect()} == pytest.approx(want)
    assert want[4, 5] == 1.0 and (6, 6) not in want


def test_leader_and_maxmin(vectors):
    _, words, bits = vectors
    of = selection.leaders(words, bits, 0.25)
    heads = []
    for i in range(40):
        like = [h for h in heads if brute(words, bits, h, i) >= 0.25]
        want = like[0] if like else i
        heads += [] if like else [i]
        assert of[i] == want
    chosen = selection.maxmin(words, bits, 6).tolist()
    want = [0]
    while len(want) < 6:
        far = [(min(1 - brute(words, bits, i, j) for j in want), -i) for i in range(40) if i not in want]
        want.append(-max(far)[1])
    assert chosen == want
    near = selection.assign(words, bits, np.array(chosen))
    for i in range(40):
        scores = [brute(words, bits, i, j) for j in chosen]
        assert near[i] == chosen[scores.index(max(scores))]


def test_promotion_takes_the_first_highest():
    of = np.array([0, 0, 0, 3, 3])
    got = selection.promote(of, np.array([np.nan, 5.0, 5.0, np.nan, np.nan]))
    assert got.tolist() == [1, 1, 1, 3, 3]


def test_network_matches_numpy(spark, vectors):
    b, words, _ = vectors
    net = scoring.Network.random(167, seed=1)
    df = spark.createDataFrame([(i, w.view(np.int64).tolist()) for i, w in enumerate(words)], "target_id long, words array<long>")
    seeds = df.where("target_id < 2").select(F.lit("u").alias("uniprot_id"), F.when(F.col("target_id") == 0, "PF1").otherwise("PF2").alias("pfam_id"), F.col("target_id").alias("query_id"), "words")
    got = scoring.learned_scores(seeds, df, {"PF1": net}, 167, threshold=0.0, top=None).collect()
    want = net(b[0] + b.astype(float))
    assert len(got) == 40 and {r.target_id: r.bsi_score for r in got} == pytest.approx(dict(enumerate(want)))


def test_cosine_handles_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "target_id int, vec array<double>")
    got = {(r.query_id, r.target_id): r.similarity for r in similarity.cosine_join(df.withColumnRenamed("target_id", "query_id"), df).collect()}
    assert got[0, 1] == 0.0 and got[1, 1] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        similarity.check_metric("cosine", {"packed": True, "dim": 8}, {"packed": False, "dim": 8})


def test_ranges_keep_rows_without_a_match_and_match_null_keys(spark):
    residues = spark.createDataFrame([("x", None, 5), ("x", "A", 10), ("x", "A", 11)], "pdb_id string, chain string, residue_number int")
    ranges = spark.createDataFrame([("x", None, "PF0", 1, 5), ("x", "A", "PF1", 1, 10), ("x", "A", "PF2", 10, 10)], "pdb_id string, chain string, pfam_id string, lo int, hi int")
    got = curation.assign_ranges(residues, ranges, ["pdb_id", "chain"], "residue_number", "lo", "hi").collect()
    assert sorted((r.residue_number, r.pfam_id or "") for r in got) == [(5, "PF0"), (10, "PF1"), (10, "PF2"), (11, "")]


def test_normalized_compounds_are_numbered_in_order(spark):
    rows = [(" a ", "C", 3), ("a", "CC", 1), ("", "C", 2), ("b", " ", 4), ("c", "O", 0), ("d", None, 5)]
    table = spark.createDataFrame(rows, "ID string, SMILES string, ord int")
    got = curation.normalize_compounds(table, "ID", "SMILES", "ord").orderBy("lig_idx").collect()
    assert [(r.chem_comp_id, r.smiles, r.lig_idx) for r in got] == [("c", "O", 0), ("a", "CC", 1)]
    rep = compounds.representation(spark.createDataFrame([(0, "CCO"), (1, None)], "lig_idx long, smiles string"), compounds.hashed_ngrams(100), 100)
    assert sorted((r.lig_idx, r.failed) for r in rep.collect()) == [(0, False), (1, True)]
    assert compounds.failures(rep).first().n_failed == 1


def test_canonical_ids_prefer_one_source(spark):
    df = spark.createDataFrame([("Z", "pdb", "k"), ("A", "chembl", "k"), ("B", "chembl", None)], "chem_comp_id string, source string, key string")
    got = {r.chem_comp_id: r.canonical_id for r in curation.canonical_ids(df, "key").collect()}
    assert got == {"Z": "Z", "A": "Z"}
