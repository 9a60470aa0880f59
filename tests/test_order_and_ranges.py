"""Row order of split files, and the binned range join, against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.operators import curation
from evirank.sources import readers


@pytest.fixture(params=["1kb", "128mb"])
def split(spark, request):
    """Files in blocks of 1 KB, or whole."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def compounds(n=700):
    rng = np.random.default_rng(2)
    return [(f"I{int(rng.integers(0, 400))}", f"C{i}N{'O' * int(rng.integers(0, 30))}") for i in range(n)]


def numbered(rows):
    first = {}
    for i, s in rows:
        first.setdefault(i, s)
    return {i: (s, at) for at, (i, s) in enumerate(first.items())}


@pytest.mark.parametrize("kind", ["smi", "csv", "tsv", "parquet"])
def test_indexes_follow_the_file(spark, tmp_path, split, kind):
    rows, path = compounds(), tmp_path / f"x.{kind}"
    if kind == "smi":
        path.write_text("".join(f"{s} {i} more\n" for i, s in rows))
    elif kind == "parquet":
        spark.createDataFrame(rows, "chem_comp_id string, smiles string").coalesce(1).write.option("parquet.block.size", 2048).parquet(str(path))
    else:
        sep = "," if kind == "csv" else "\t"
        path.write_text(f"chem_comp_id{sep}smiles\n" + "".join(f"{i}{sep}{s}\n" for i, s in rows))
    df = readers.read_compounds(spark, str(path))
    if split == "1kb" and kind != "parquet":
        assert df.rdd.getNumPartitions() > 3
    got = curation.normalize_compounds(df, "chem_comp_id", "smiles", "ord").collect()
    assert {r.chem_comp_id: (r.smiles, r.lig_idx) for r in got} == numbered(rows)


def test_a_folder_is_read_file_by_file(spark, tmp_path, split):
    rows, parts = compounds(), []
    for i, name in enumerate(["b", "a/c", "a/a", "z"]):
        part = rows[i * 175 : (i + 1) * 175][: 175 - 40 * i]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.smi").write_text("".join(f"{s}\t{c}\n" for c, s in part))
        parts.append((f"{name}.smi", part))
    got = curation.normalize_compounds(readers.read_smi_folder(spark, str(tmp_path)), "chem_comp_id", "smiles", "ord").collect()
    assert {r.chem_comp_id: (r.smiles, r.lig_idx) for r in got} == numbered([x for _, part in sorted(parts) for x in part])


def test_the_last_sequence_and_the_first_structure_win(spark, tmp_path, split):
    rows = compounds()
    (tmp_path / "s.fasta").write_text("\n" + "".join((f">sp|{i}|NAME a > b >> c\n" if at % 2 else f">{i} text\r\n") + f"{s[:9]}\n{s[9:]}\n\n" for at, (i, s) in enumerate(rows)))
    got = {r.accession: r.sequence for r in readers.read_fasta_sequences(spark, str(tmp_path / "s.fasta")).collect()}
    assert got == dict(rows)
    (tmp_path / "s.tsv").write_text("# a comment\n" + "".join(f"{s}\t{i.lower()}\tname\n" for i, s in rows))
    assert {r.chem_comp_id: r.smiles for r in readers.read_structures(spark, str(tmp_path / "s.tsv")).collect()} == {i: s for i, (s, _) in numbered(rows).items()}


@pytest.mark.parametrize("width", [None, 1, 7, 10_000])
def test_ranges_in_bins_equal_brute_force(spark, width):
    rng = np.random.default_rng(6)
    residues = [(("a", "b", None)[int(rng.integers(3))], i, None if i % 50 == 0 else int(rng.integers(-30, 200))) for i in range(400)]
    ranges = [(("a", "b", None)[int(rng.integers(3))], f"R{i}", int(lo), int(lo + n)) for i, (lo, n) in enumerate(zip(rng.integers(-40, 180, 80), rng.choice([-3, 0, 1, 5, 40, 300], 80), strict=True))]
    ranges += [("a", "null", None, 5), ("a", "null", 5, None)]
    got = curation.assign_ranges(
        spark.createDataFrame(residues, "chain string, id int, pos int"), spark.createDataFrame(ranges, "chain string, name string, lo int, hi int"), ["chain"], "pos", "lo", "hi", width
    )
    assert got.columns == ["chain", "id", "pos", "name", "lo", "hi"]
    want = []
    for k, i, p in residues:
        held = [r for r in ranges if r[0] == k and p is not None and r[2] is not None and r[3] is not None and r[2] <= p <= r[3]]
        want += [(k, i, p, *r[1:]) for r in held] or [(k, i, p, None, None, None)]
    key = lambda r: tuple((x is None, x or 0) for x in r[1:2]) + tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_a_hot_key_meets_in_small_groups(spark):
    """One chain with 40,000 residues and 4,000 ranges: 160 million pairs on the key, a few a bin."""
    residues = spark.range(40_000).select(F.lit("x").alias("chain"), F.col("id").alias("pos"))
    ranges = spark.range(4_000).select(F.lit("x").alias("chain"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 4).alias("hi"))
    got = curation.assign_ranges(residues, ranges, ["chain"], "pos", "lo", "hi")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and "__range_bin" in plan
    assert got.count() == 40_000 and got.where("lo is not null").count() == 20_000
