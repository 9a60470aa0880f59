"""What the views of known ligands read: each protein's first row, not every candidate with every ligand."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from evirank.operators import known, results
from evirank.plans import catalog, pages

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["best_per_compound", "sources_by_method"])
def test_view_reads_reduced_pairs(spark, monkeypatch, name):
    pairs = catalog.known_for_candidates(spark, SF).cache()
    plain, given = getattr(pages, name), []
    monkeypatch.setattr(pages, name, lambda df, *a: given.append(df) or plain(df, *a))
    got = sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()))
    if name == "best_per_compound":
        want, keys = plain(pairs, "chem_comp_id", ["qseqid", "sseqid", "source"]).select("chem_comp_id", "qseqid", "sseqid", "search_type"), ["sseqid", "chem_comp_id"]
    else:
        want, keys = plain(pairs).withColumn("sources", F.array_join("sources", ",")), ["sseqid", "search_type", "source"]
    assert got == sorted(map(tuple, want.collect())) and got
    assert given[0].count() == pairs.select(*keys).distinct().count() < pairs.count()


def test_first_ligands_with_nulls_and_ties(spark):
    cand = spark.createDataFrame([(3, 1, "domain"), (2, 1, "nearest_k"), (None, 1, "sequence"), (4, 1, "sequence"), (5, 2, "sequence"), (6, None, "sequence"), (7, 9, "domain")], "qseqid int, sseqid int, search_type string")
    rows = [(1, "a", "d", "y"), (1, "a", "d", "x"), (2, "a", "d", "w"), (2, "b", None, "w"), (None, "a", "d", "x"), (1, "c", "d", "x"), (9, "e", "d", None), (9, "a", "d", "z")]
    binding = spark.createDataFrame(rows, "uniprot_id int, chem_comp_id string, pfam_id string, source string")
    shapes = spark.createDataFrame([("a", "C"), ("a", "CC"), ("b", "N"), ("c", None), (None, "O"), ("e", "F")], "chem_comp_id string, smiles string")
    got = results.first_ligands_of(cand, known.known_rows(binding, shapes))
    assert {tuple(r) for r in got.select("qseqid", "sseqid", "search_type", "chem_comp_id", "source").collect()} == {(4, 1, "sequence", "a", "x"), (5, 2, "sequence", "a", "w"), (7, 9, "domain", "a", "z")}
