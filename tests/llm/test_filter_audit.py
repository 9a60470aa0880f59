"""The filter audit against a walk of every order, document by document."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from evirank.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"


def brute(docs: list[tuple], labels: list[tuple]) -> dict:
    rows = []
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs) else set()
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, "".join(order), step] = (len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, shapley[order[step - 1]])
    return out


def rows_of(df) -> dict:
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_odd_rows_equal_the_walk(spark, odd_docs, no_docs):
    more = [(100 + i, t, s) for i, (t, s) in enumerate([("a b # " * 30, "a"), ("A B C " * 5, ""), ("a b # " * 30, None), (" ".join(f"w{i}" for i in range(60)), "q"), (" ".join(f"W{i}" for i in range(60)), "q"), ("AB", "a")])]
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()] + more
    labels = [(1, 1, 0), (1, 0, 1), (6, 1, None), (None, 1, 1), (100, 1, 1), (101, 0, 1), (102, None, None), (105, 1, 0), (9999, 1, 1)]
    df = odd_docs.select("doc_id", "text", "source").union(spark.createDataFrame(more, "doc_id long, text string, source string")).selectExpr("*", "1 as part", "2 as A", "3 as good", "'x' as state")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.audit(df.repartition(3), table)) == brute(docs, labels)
    assert filter_audit.audit(no_docs, table).count() == 0
    assert rows_of(filter_audit.audit(df, table.limit(0))) == brute(docs, [])


def test_each_state_is_counted_once_and_nothing_stays_cached(spark, odd_docs):
    rows = filter_audit.with_labels(filter_audit.with_copies(filter_audit.text_flags(odd_docs)), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    edges = filter_audit.edge_counts(rows, list("ABCDE"))
    states = [r.state for r in edges.where("part = 'a'").collect()]
    assert len(states) == len(set(r for r in edges.select("part", "state", "filter").where("part = 'a'").collect()))
    assert max(states) < 31
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()
    with pytest.raises(ValueError):
        filter_audit.edge_counts(rows, [])


def test_op12_equals_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(queries.ORACLES["op12_filter_audit"])
    columns = theirs.columns
    ours = queries.op12_filter_audit(spark, SF).select(*columns)
    assert sorted(tuple(r) for r in ours.collect()) == sorted(theirs.fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert rows_of(ours) == brute(docs, labels)
