from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evirank.functions import text
from evirank.sources import readers, writers


def put(path, content):
    path.write_text(content)
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path / "q.fasta", ">same first\nACDE\n>unique\nFGHI\n\n>same duplicate\nKLMN\n")
    assert [r.qseqid for r in readers.read_fasta_queries(spark, path).collect()] == ["same", "unique", "same"]
    row = readers.fasta_details(spark.read.text(path)).first()
    assert (row.valid, row.n_records, row.n_residues, row.repeated) == (True, 3, 12, ["same"])
    empty = readers.fasta_details(spark.read.text(put(tmp_path / "e.fasta", "ACDE\n"))).first()
    assert not empty.valid and empty.repeated == []
    multi = put(tmp_path / "m.fasta", ">sp|P1|NAME x\nAC\nDE\n>other y\nFG\n>tr|P1|N\nKK\n")
    assert {r.accession: r.sequence for r in readers.read_fasta_sequences(spark, multi).collect()} == {"P1": "KK", "other": "FG"}


def test_fasta_writer_wraps(spark):
    df = spark.createDataFrame([("a", "A" * 120), ("b", "AC"), ("c", None)], "accession string, sequence string")
    assert sorted(r.value for r in writers.fasta_records(df).collect()) == [">a\n" + "A" * 60 + "\n" + "A" * 60, ">b\nAC"]


def test_tool_tables(spark, tmp_path):
    blast = put(tmp_path / "b.tsv", "q\ts\t90.5\t100\t1\t0\t1\t100\t1\t100\t1e-20\t200\t100\t120\n")
    row = readers.read_blast(spark, blast).first()
    assert (row.pident, row.length, row.slen) == (90.5, 100, 120)
    fields = "Kinase PF00069.20 260 q1 - 300 1e-30 100.0 0.1 1 1 1e-20 1e-18 90.0 0.1 1 250 10 260 5 270 0.95 some description".split()
    path = put(tmp_path / "h.tbl", "# head\n\n" + "  ".join(fields) + "\n")
    row = readers.read_hmmer(spark, path).first()
    assert (row.qseqid, row.pfam_id, row.dom_score, row.dom_i_evalue, row.acc) == ("q1", "PF00069", 90.0, 1e-18, 0.95)


def test_compound_tables(spark, tmp_path):
    smi = put(tmp_path / "x.smi", "CC(=O)O a extra\nbad\nC#N b\n")
    assert [(r.smiles, r.chem_comp_id) for r in readers.read_compounds(spark, smi).orderBy("ord").collect()] == [("CC(=O)O", "a"), ("C#N", "b")]
    tsv = put(tmp_path / "x.txt", "ID\tSMILES\n1\tC\n")
    df = readers.read_compounds(spark, tsv)
    assert readers.pick_column(df.columns, readers.STRUCTURE_COLUMNS, "structure") == "SMILES" and readers.pick_column(df.columns, readers.ID_COLUMNS, "id") == "ID"
    with pytest.raises(ValueError):
        readers.read_compounds(spark, str(tmp_path / "x.doc"))
    with pytest.raises(ValueError):
        readers.pick_column(["foo"], readers.ID_COLUMNS, "id")
    (tmp_path / "deep" / "er").mkdir(parents=True)
    put(tmp_path / "deep" / "er" / "y.smi", "O w\n")
    put(tmp_path / "deep" / "z.smi", "N v\n")
    assert {r.chem_comp_id for r in readers.read_smi_folder(spark, str(tmp_path / "deep")).collect()} == {"w", "v"}
    ccd = put(tmp_path / "ccd.tsv", "C#N\tabc\tname\nCC\tABC\tname\n")
    assert [(r.chem_comp_id, r.smiles) for r in readers.read_structures(spark, ccd).collect()] == [("ABC", "C#N")]


def test_binding_sites(spark, tmp_path):
    path = put(tmp_path / "s.json", '{"pdb_id": "1abc", "sites": [{"site_id": "A1", "ligand_residues": [{"chem_comp_id": "LIG", "chain_id": "A", "author_residue_number": 7}], "site_residues": [{"chain_id": "B", "author_residue_number": 5}, {"chain_id": "B"}]}, {"site_id": "E"}]}\n')
    got = sorted((r.chem_comp_id, r.residue_number or 0) for r in readers.read_binding_sites(spark, path).collect())
    assert got == [("LIG", 0), ("LIG", 5)]
    ranges = put(tmp_path / "r.tsv", "# x\nPDB\tCHAIN\tPFAM_ACCESSION\tAUTH_PDBRES_START\tAUTH_PDBRES_END\n1ABC\tA\tPF1\t1\t9\n1ABC\tA\tPF2\tNone\t9\n")
    assert [r.pfam_id for r in readers.read_pfam_ranges(spark, ranges).collect()] == ["PF1"]


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first().x
    assert val(text.parse_list(F.lit("['a', \"b c\"]"))) == ["a", "b c"] and val(text.parse_list(F.lit("[a; b  c]"))) == ["a", "b", "c"]
    assert val(text.parse_list(F.lit("x; y,z"))) == ["x", "y", "z"] and val(text.strip_version(F.lit("PF1.2"))) == "PF1"
    assert val(text.display_source(F.lit("chembl"), F.lit("CHEMBL12"))) == "chembl" and val(text.display_source(F.lit("chembl"), F.lit("ATP"))) == "pdb_chembl"
    assert val(text.latest_release(F.lit("chembl_9/ chembl_35/"))) == 35 and val(text.safe_name(F.lit("a b-c_d"))) == "a_b-c_d"
    assert val(text.nan_to_null(F.lit(float("nan")))) is None and val(text.prefixed(F.lit("12"), "ZINC")) == "ZINC12"
    rows = [
        ("my_chemberta", None, None, None, None, "cosine"), ("x", None, None, True, None, "tanimoto"), ("bert", "Tanimoto", None, False, "m", "tanimoto"), ("x", "other", None, False, None, "cosine"),
        ("x", None, "morgan", False, "m", "tanimoto"), ("x", None, None, None, "m", "cosine"), (None, None, "", None, "", "tanimoto"), ("maccs", "COSINE", "maccs", True, None, "cosine"),
    ]
    table = spark.createDataFrame(rows, "name string, search_metric string, fingerprint_type string, packed_bits boolean, model_id string, want string")
    assert table.where(text.search_metric(*(F.col(c) for c in table.columns[:5])) != F.col("want")).count() == 0
    label = lambda given, kind, bits: val(text.representation_label(F.lit(given).cast("string"), F.lit(kind), F.lit(bits).cast("int")))
    assert [label(None, "ap", 512), label("own", "ap", None), label(None, "maccs", None), label("", "embedding", None)] == ["atom_pair_512", "own", "maccs_167", "chemberta_zinc_base_768"]
    for kind, bits in (("nope", 1), ("ap", None)):
        with pytest.raises(Exception, match="no name for kind"):
            label(None, kind, bits)
    assert text.default_threshold("maccs") == 0.831169
    with pytest.raises(ValueError):
        text.default_threshold("nope")
    assert text.fingerprint({"a": 1, "b": 2}) == text.fingerprint({"b": 2, "a": 1})


def test_summary_and_per_query_files(spark, tmp_path):
    df = spark.createDataFrame([("q2", 1), ("q1", 2)], "qseqid string, n int")
    writers.write_summary(df, str(tmp_path / "s"))
    lines = [x for p in (tmp_path / "s").glob("part-*.csv") for x in p.read_text().splitlines()]
    assert lines == ["qseqid\tn", "q1\t2", "q2\t1"]
    writers.write_per_query(df, str(tmp_path / "per"))
    assert {p.name for p in (tmp_path / "per").iterdir() if p.is_dir()} == {"qseqid=q1", "qseqid=q2"}
