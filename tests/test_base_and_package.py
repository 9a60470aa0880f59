"""Compound bases, gathering vectors, and what a data package lacks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evirank.operators import compounds
from evirank.plans import package


def test_a_package_that_lacks_a_file_is_not_ready(spark, tmp_path):
    for name in ("core.dat", "ecfp.dat"):
        (tmp_path / name).write_text("x")
    (tmp_path / "empty").mkdir()
    got = package.ready(spark, str(tmp_path), ["core.dat", "fcfp.dat", "core.dat", "empty"], {"ecfp": ["ecfp.dat"], "fcfp": ["ecfp.dat", "fcfp.dat"]})
    assert got == {"ready": False, "missing": ["fcfp.dat", "empty"], "optional": {"ecfp": True, "fcfp": False}}
    assert package.ready(spark, str(tmp_path), ["core.dat"])["ready"]


def test_vectors_come_as_they_are_asked(spark):
    vectors = spark.createDataFrame([("a", [1], 1), ("b", [3], 2), ("c", [7], 3)], "chem_comp_id string, words array<long>, bitcount int")
    asked = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c")], "position int, chem_comp_id string")
    got = compounds.gather(vectors, asked, "chem_comp_id").orderBy("position").collect()
    assert [(r.chem_comp_id, r.bitcount) for r in got] == [("c", 3), ("a", 1), ("c", 3)]
    more = asked.union(spark.createDataFrame([(3, "z")], asked.schema))
    assert compounds.gather(vectors, more, "chem_comp_id", strict=False).count() == 3
    with pytest.raises(Exception, match="no vector of chem_comp_id z"):
        compounds.gather(vectors, more, "chem_comp_id").collect()


def test_a_build_that_fails_leaves_the_base_before(spark, tmp_path):
    path, ngrams = str(tmp_path / "base"), compounds.hashed_ngrams(64)
    table = lambda *rows: spark.createDataFrame(rows, "id string, s string, ord int")
    compounds.build_base(table((" a", "CCO", 2), ("a", "CCC", 1), ("b", "", 0), ("c", "N", 3)), "id", "s", "ord", {"x": (ngrams, 64), "y": (ngrams, 64)}, path)
    rows = lambda: {(r.chem_comp_id, r.smiles, r.lig_idx, r.failed) for r in compounds.open_base(spark, path, "y").collect()}
    assert rows() == {("a", "CCC", 0, False), ("c", "N", 1, True)}

    def broken(structures):
        raise RuntimeError("broken featurizer")

    with pytest.raises(Exception, match="broken featurizer"):
        compounds.build_base(table(("q", "CCCC", 1)), "id", "s", "ord", {"x": (ngrams, 64), "y": (broken, 64)}, path)
    assert rows() == {("a", "CCC", 0, False), ("c", "N", 1, True)}
    assert compounds.open_base(spark, path, "x").where(F.col("bitcount") > 0).count() == 1
