"""Candidates from the hits that share a domain only, and other proteins only where hits are too few."""

from __future__ import annotations

import numpy as np
import pytest

from evirank.operators import candidates

TIE = ["ord"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    pick = lambda n, k: rng.integers(0, k, n).tolist()
    hits = [(f"q{q}", s, 90.0, 45.0, 50.0, 50.0, e / 10, None if b < 3 else float(b), i) for i, (q, s, e, b) in enumerate(zip(pick(600, 12), pick(600, 60), pick(600, 5), pick(600, 12), strict=True))]
    hits += [(None, 1, 90.0, 45.0, 50.0, 50.0, 0.0, 1.0, 1000), ("q1", None, 90.0, 45.0, 50.0, 50.0, 0.0, 1.0, 1001)]
    hits = spark.createDataFrame(hits, "qseqid string, sseqid long, pident double, length double, qlen double, slen double, evalue double, bitscore double, ord long")
    domains = spark.createDataFrame([*{(s, f"d{d}") for s, d in zip(pick(150, 60), pick(150, 9), strict=True)}, (None, "d1"), (3, None)], "uniprot_id long, pfam_id string")
    found = spark.createDataFrame([*[(f"q{q}", f"d{d}", float(a), b / 10) for q, d, a, b in zip(pick(25, 12), pick(25, 9), pick(25, 9), pick(25, 5), strict=True)], ("q1", None, 1.0, 1.0)], "qseqid string, pfam_id string, dom_score double, dom_i_evalue double")
    return hits, domains, found


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hits_that_share_a_domain_give_the_same_candidates(spark, tables):
    hits, domains, found = tables
    some = candidates.sharing_hits(hits, domains, found)
    assert 0 < some.count() < hits.where("qseqid is not null and sseqid is not null").count() and some.columns == hits.columns
    best, few = (candidates.best_hit_per_pair(h, TIE) for h in (hits, some))
    assert few.count() < best.count()
    assert rows(candidates.nearest_k(candidates.nearest_pool(best, None), domains, found, 3)) == rows(candidates.nearest_k(candidates.nearest_pool(few, None), domains, found, 3, shared=True))
    for n in (1, 2, 5, 30):
        assert rows(candidates.domain_top_n(found, domains, best, n)) == rows(candidates.domain_top_n(found, domains, few, n))


@pytest.mark.parametrize("n", [1, 3, 8])
def test_domain_top_n_against_all_pairs(spark, tables, n):
    hits, domains, found = tables
    best = {(r.qseqid, r.sseqid): r for r in candidates.best_hit_per_pair(hits, TIE).collect()}
    owned = {}
    for r in domains.collect():
        owned.setdefault(r.pfam_id, set()).add(r.uniprot_id)
    want = set()
    for q, d in {(r.qseqid, r.pfam_id) for r in found.collect() if r.pfam_id}:
        def by(s):
            h = best.get((q, s))
            last = lambda v, sign=1: (v is None, 0 if v is None else sign * v)
            return (h is None or h.bitscore is None, *((last(h.bitscore, -1), last(h.evalue), last(h.pident, -1), last(h.qcov, -1), last(h.scov, -1)) if h else ((True, 0),) * 5), s)

        want |= {(q, s, d) for s in sorted((s for s in owned.get(d, ()) if s is not None), key=by)[:n]}
    got = candidates.domain_top_n(found, domains, candidates.best_hit_per_pair(hits, TIE), n).select("qseqid", "sseqid", "pfam_id").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_counts_are_looked_up_for_those_without_one(spark, tables):
    _, domains, found = tables
    given = spark.createDataFrame([("q1", 1, 7), ("q1", 2, None), ("q99", 3, None), ("q2", 4, None)], "qseqid string, sseqid long, n_shared_domains long")
    of_query = {q: {r.pfam_id for r in found.collect() if r.qseqid == q and r.pfam_id} for q in ("q1", "q2", "q99")}
    of = {s: {r.pfam_id for r in domains.collect() if r.uniprot_id == s} for s in (2, 3, 4)}
    want = {("q1", 1): 7} | {(q, s): len(of_query[q] & of[s]) for q, s in (("q1", 2), ("q99", 3), ("q2", 4))}
    assert {(r.qseqid, r.sseqid): r.n_shared_domains for r in candidates.with_shared_domains(given, domains, found).collect()} == want
