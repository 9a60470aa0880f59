"""The predicted path with chosen seeds against plain Python, the result tables, and the sequence upkeep."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from evirank.operators import build, predicted, selection
from evirank.sources import writers


def vector(*ones: int) -> tuple[list[int], int]:
    return [sum(1 << i for i in ones)], len(ones)


def test_seeds_are_the_representatives(spark):
    rng = np.random.default_rng(3)
    rows = [(p, q, float(rng.integers(0, 9)) if q % 3 else None, *vector(*sorted(set(rng.integers(0, 12, 8).tolist())))) for p in "ab" for q in range(14)]
    seeds = spark.createDataFrame(rows, "uniprot_id string, query_id long, value double, words array<long>, bitcount int")
    got = {(r.uniprot_id, r.query_id) for r in predicted.representative_seeds(seeds, 0.6, 50).collect()}
    want = set()
    for p in "ab":
        mine = [r for r in rows if r[0] == p]
        words, bits = np.array([r[3] for r in mine], np.int64).view(np.uint64), np.array([r[4] for r in mine])
        of = selection.promote(selection.choose(words, bits, 50, 0.6), np.array([np.nan if r[2] is None else r[2] for r in mine]))
        want |= {(p, mine[i][1]) for i in set(of.tolist())}
    assert got == want and len(got) < len(rows)


def test_predicted_rows_are_distinct_compounds(spark):
    known = spark.createDataFrame([("p", 1, 7.0), ("p", 1, 8.0), ("p", 9, None), ("q", 1, None), (None, 1, 9.0)], "uniprot_id string, chem_comp_id long, pchembl double")
    vectors = spark.createDataFrame([(1, *vector(0, 1, 2, 3))], "chem_comp_id long, words array<long>, bitcount int")
    seeds = predicted.seeds_of(known, vectors)
    assert {(r.uniprot_id, r.query_id, r.value) for r in seeds.collect()} == {("p", 1, 8.0), ("q", 1, None)}
    targets = spark.createDataFrame([(0, *vector(0, 1, 2, 3)), (1, *vector(0, 1, 2)), (2, *vector(0, 1)), (3, *vector(8))], "target_id long, words array<long>, bitcount int")
    compounds = spark.createDataFrame([(0, "A", "s"), (1, "A", "s"), (2, "B", "s")], "lig_idx long, chem_comp_id string, smiles string")
    found = predicted.predicted_ligands(seeds, targets, compounds, 0.5, prefix="Z").where("uniprot_id = 'p'").orderBy("chem_comp_id").collect()
    assert [(r.chem_comp_id, r.tanimoto) for r in found] == [("ZA", 1.0), ("ZB", 0.5)]
    below = predicted.predicted_ligands(seeds, targets, compounds, 0.5, maximum=0.8, keep=1).where("uniprot_id = 'p'").collect()
    assert [(r.chem_comp_id, r.tanimoto) for r in below] == [("A", 0.75)]


def test_result_tables_of_a_query(spark, tmp_path):
    ranking = spark.createDataFrame([("q1", "p"), ("q2", "p")], "qseqid string, sseqid string")
    writers.write_results(ranking, ranking.where("qseqid = 'q1'"), ranking.limit(0), str(tmp_path / "out"))
    folders = {t: sorted(x for x in os.listdir(tmp_path / "out" / t) if x.startswith("qseqid")) for t in ("protein_ranking", "known_ligands", "predicted_ligands")}
    assert folders == {"protein_ranking": ["qseqid=q1", "qseqid=q2"], "known_ligands": ["qseqid=q1"], "predicted_ligands": []}


def test_sequence_changes(spark):
    held = spark.createDataFrame([("A", "x"), ("B", "y")], "accession string, sequence string")
    wanted = spark.createDataFrame([(" A ",), ("C",), ("C",), ("nan",), ("",), (None,), ("D",)], "accession string")
    assert {tuple(r) for r in build.sequence_changes(held, wanted).collect()} == {("C", "new"), ("D", "new"), ("B", "obsolete")}
    fetched = spark.createDataFrame([("C", "z"), ("A", "other")], "accession string, sequence string")
    assert {tuple(r) for r in build.sync_sequences(held, wanted, fetched).collect()} == {("A", "x"), ("C", "z")}


def test_a_ligand_without_a_vector_stays_possible(spark):
    row = "uniprot_id string, chem_comp_id string, pfam_id string"
    trusted, possible = spark.createDataFrame([("p", "T", "d")], row), spark.createDataFrame([("p", "X", "d"), ("p", "Y", "d")], row)
    vectors = spark.createDataFrame([("T", *vector(1, 2)), ("X", *vector(1, 2))], "chem_comp_id string, words array<long>, bitcount int")
    merged, rest = build.merge_relations(trusted, possible.limit(0), possible, possible.select("chem_comp_id", F.col("chem_comp_id").alias("canonical_id")).limit(0), vectors, 0.5)
    assert {r.chem_comp_id for r in merged.collect()} == {"T", "X"} and [r.chem_comp_id for r in rest.collect()] == ["Y"]
