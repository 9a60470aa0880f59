"""Providers over the cache, and answers of structure services with broken files among them."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from evirank.plans import catalog, providers
from evirank.plans.cache import Cache, CacheError
from evirank.sources import fetched
from evirank.streaming import limits


class Fake(providers.Provider):
    """Two hits a protein, one at the minimum; counts what it is asked."""

    name, asked = "fake", []

    def compute(self, proteins):
        Fake.asked.append(sorted(r.uniprot_id for r in proteins.collect()))
        return proteins.crossJoin(self.tables["hits"]).where(F.col("score") >= self.minimum)


@pytest.fixture()
def fake(spark):
    Fake.asked = []
    return Fake({"hits": spark.createDataFrame([("x", 0.4), ("y", 0.9)], "target_id string, score double")}, {"search_metric": "tanimoto", "search_representation": "r"}, 0.4)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "uniprot_id string")


def test_precompute_goes_on_where_it_stopped(spark, tmp_path, fake):
    cache, names = Cache(spark, str(tmp_path / "c"), "score"), [f"P{i}" for i in range(20)]
    wanted = ids(spark, *names, *names, None)
    assert providers.precompute(cache, fake, wanted, 4) == 20
    assert sorted(x for part in Fake.asked for x in part) == sorted(names) and 1 < len(Fake.asked) <= 4
    assert providers.precompute(cache, fake, wanted, 3) == 20 and len(Fake.asked) <= 4
    assert providers.cached(cache, fake, ids(spark, "P1", "P2"), read_only=True).count() == 4
    assert providers.cached(cache, fake.band(0.5), ids(spark, "P1"), read_only=True).count() == 1  # a stricter band
    with pytest.raises(CacheError):
        providers.cached(cache, fake.band(0.3), ids(spark, "P1"), read_only=True)
    with pytest.raises(CacheError):
        providers.cached(cache, fake, ids(spark, "P1", "Q"), read_only=True)
    with pytest.raises(ValueError):
        providers.cached(cache, fake, wanted, read_only=True, rebuild=True)
    before = len(Fake.asked)
    assert providers.precompute(cache, fake, ids(spark, "P1"), rebuild=True) == 1 and len(Fake.asked) == before + 1
    with pytest.raises(CacheError):  # a rebuild starts anew
        providers.cached(cache, fake, ids(spark, "P2"), read_only=True)


def test_a_missing_cache_is_not_made_by_a_reader(spark, tmp_path, fake):
    with pytest.raises(CacheError):
        providers.cached(Cache(spark, str(tmp_path / "none"), "score"), fake, ids(spark, "P12345"), read_only=True)
    assert not (tmp_path / "none").exists() and Fake.asked == []


def test_other_data_are_another_request(spark, tmp_path, fake):
    cache = Cache(spark, str(tmp_path / "c"), "score")
    providers.cached(cache, fake, ids(spark, "a"))
    changed = Fake({"hits": spark.createDataFrame([("x", 0.4), ("y", 0.8)], "target_id string, score double")}, fake.settings, 0.4)
    assert {r.score for r in providers.cached(cache, changed, ids(spark, "a")).collect()} == {0.4, 0.8} and len(Fake.asked) == 2


def test_learned_provider_uses_the_cache(spark, tmp_path):
    from evirank.operators import scoring

    words = [[int(x)] for x in (0b1011, 0b1110, 0b0111)]
    vectors = spark.createDataFrame([(f"L{i}", w, 3) for i, w in enumerate(words)], "chem_comp_id string, words array<long>, bitcount int")
    tables = {
        "domains": spark.createDataFrame([("p", "PF1"), ("q", "PF1")], "uniprot_id string, pfam_id string"), "registry": spark.createDataFrame([("PF1", 0.5)], "pfam_id string, val_pr_auc double"),
        "models": scoring.model_table(spark, {"PF1": scoring.Network.random(4, (3,), 1)}), "known": spark.createDataFrame([("p", "L0", 1.0), ("q", "L1", None)], "uniprot_id string, chem_comp_id string, pchembl double"),
        "vectors": vectors, "targets": spark.createDataFrame(list(enumerate(words)), "target_id long, words array<long>"), "compounds": spark.createDataFrame([(i, f"C{i}", "s") for i in range(3)], "lig_idx long, chem_comp_id string, smiles string"),
    }
    provider, cache = providers.LearnedProvider(tables, {"dim": 4, "limit": None}, 0.0), Cache(spark, str(tmp_path / "c"), "bsi_score")
    first = sorted(map(tuple, providers.cached(cache, provider, ids(spark, "p", "q")).collect()))
    assert len(first) == 6 and sorted(map(tuple, providers.cached(cache, provider, ids(spark, "p", "q"), read_only=True).collect())) == first
    assert {r.uniprot_id for r in provider.compute(ids(spark, "q")).collect()} == {"q"}


def answer(**fields):
    return json.dumps({"id": 1, fetched.DESCRIPTOR: fields})


ANSWERS = {
    "abc": answer(smiles="CC", smiles_stereo="C@C"), "DEF": answer(smiles="  ", smiles_stereo=None, smiles_canonical=" CCO "), "GHI": answer(), "JKL": '{"a": ', "MNO": "", "PQR": '{"other": 1}',
    "STU": '["not", "an", "object"]', "VWX": answer(smiles="C#N")[:-4],
}
WANT = {"ABC": ("ok", "CC"), "DEF": ("ok", "CCO"), "GHI": ("empty", None), "JKL": ("broken", None), "PQR": ("empty", None), "VWX": ("broken", None)}


def test_broken_files_are_reported_not_dropped(spark, tmp_path):
    for name, body in ANSWERS.items():
        (tmp_path / f"{name}.json").write_text(body)
    (tmp_path / "notes.txt").write_text("{}")
    rows = {r.chem_comp_id: r for r in fetched.read_answers(spark, str(tmp_path)).collect()}
    for name, (status, smiles) in WANT.items():
        assert (rows[name].status, rows[name].smiles) == (status, smiles), name
        assert (rows[name].raw is not None) == (status == "broken")
    assert "NOTES" not in rows
    tabled = {r.chem_comp_id: r for r in fetched.parse_answers(spark.createDataFrame([*ANSWERS.items(), (" abc ", "{"), ("NUL", None), (" ", "{}"), (None, "{}")], "chem_comp_id string, body string")).collect()}
    for name, (status, smiles) in (WANT | {"NUL": ("broken", None)}).items():
        assert (tabled[name].status, tabled[name].smiles) == (status, smiles), name
    assert len(tabled) == len(ANSWERS) + 1


def test_failed_ids_are_asked_again_until_the_limit(spark):
    ligands = spark.createDataFrame([(x,) for x in ("a", "A ", "b", "c", "d", "", None, "t")], "chem_comp_id string")
    structures = spark.createDataFrame([("T", "CT"), ("U", "CU")], "chem_comp_id string, smiles string")
    rounds = [{"a": "{", "c": answer()}, {"a": answer(smiles="CA"), "b": "{", "z": answer(smiles="CZ")}, {"b": answer(smiles="CB")}, {"d": answer(smiles="CD")}]
    ledger, asked_for, table = fetched.empty_ledger(spark), [], None
    kept = spark.createDataFrame([], "chem_comp_id string, body string")
    for bodies in rounds:
        asked = spark.createDataFrame(fetched.to_fetch(ligands, structures, ledger, 3).collect(), "chem_comp_id string")
        asked_for.append(sorted(r.chem_comp_id for r in asked.collect()))
        new = spark.createDataFrame(list(bodies.items()), "chem_comp_id string, body string")
        kept = kept.union(new)
        ledger = spark.createDataFrame(fetched.record(ledger, asked, fetched.parse_answers(new)).collect(), "chem_comp_id string, status string, attempts int")
        table = fetched.structure_table(ligands, structures, fetched.parse_answers(kept))
    assert asked_for == [["A", "B", "C", "D"], ["A", "B", "D"], ["B", "D"], []]
    assert {tuple(r) for r in ledger.collect()} == {("A", "ok", 2), ("B", "ok", 3), ("C", "empty", 1), ("D", "absent", 3)}
    assert {(r.chem_comp_id, r.smiles) for r in table.collect()} == {("A", "CA"), ("B", "CB"), ("D", "CD"), ("T", "CT")}


def test_the_rate_limit_of_a_table_read_as_a_stream(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{sf}/events.parquet")
    last = events.agg(F.max("ts")).first()[0]
    got = {r.event_id: (r.accepted, r.retry_after) for r in catalog.QUERIES["rate_limit_stream"](spark, sf).collect()}
    want = limits.rate_limited(events, "user_id", "ts", "event_id", 2, 86_400).where(F.col("ts") <= F.lit(last) - F.expr("interval 600 seconds"))
    assert got == {r.event_id: (r.accepted, r.retry_after) for r in want.collect()}
