from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evirank.plans import pages
from evirank.plans.cache import Cache, CacheError, Request, covers, select
from evirank.streaming import limits

SIGNATURE = {"search_metric": "tanimoto", "search_representation": "x"}


def test_coverage_algebra():
    r = lambda lo, hi=None: Request(SIGNATURE, lo, hi)
    assert covers(r(0.4), r(0.5)) and covers(r(0.4), r(0.5, 0.9)) and covers(r(0.4, 0.9), r(0.4, 0.9))
    assert not covers(r(0.5), r(0.4)) and not covers(r(0.4, 0.9), r(0.5)) and not covers(Request({}, 0.1), r(0.5))
    entries = [(r(0.1), 3), (r(0.4), 3), (r(0.4, 0.95), 3), (r(0.5), 2), (r(0.7), 9)]
    assert select(entries, r(0.6, 0.9)) == 2 and select(entries, r(0.6)) == 1 and select([], r(0.1)) is None


def test_fetch_fills_only_what_is_missing(spark, tmp_path):
    calls = []

    def compute(needed):
        calls.append(sorted(r.uniprot_id for r in needed.collect()))
        return needed.where("uniprot_id <> 'none'").select("uniprot_id", F.lit("l").alias("target_id"), F.lit(0.6).alias("tanimoto"))

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "uniprot_id string")
    cache = Cache(spark, str(tmp_path / "c"))
    wide = Request(SIGNATURE, 0.4)
    with pytest.raises(CacheError):
        cache.fetch(wide, ids("a"), compute, read_only=True)
    assert not (tmp_path / "c").exists()
    assert cache.fetch(wide, ids("a", "none"), compute).count() == 1
    assert cache.fetch(Request(SIGNATURE, 0.5, 0.9), ids("a", "none"), compute).count() == 1  # a stricter request reuses it
    assert cache.fetch(Request(SIGNATURE, 0.7), ids("a"), compute).count() == 0
    assert cache.fetch(wide, ids("a", "b"), compute).count() == 2
    assert calls == [["a", "none"], ["b"]]
    with pytest.raises(CacheError):
        cache.fetch(wide, ids("z"), compute, read_only=True)
    assert cache.missing(wide.namespace(), ids("a", "z")) == 1
    assert cache.invalidate(wide.namespace()) and cache.entries() == []


def test_pages(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", 5.0), (3, "y", 7.0), (4, "x", 9.0)], "id int, kind string, v double")
    got = [r.id for r in pages.page(df, 1, 2, {"kind": "x", "other": "z"}, "v", True, ["id"]).collect()]
    assert got == [4, 2] and [r.id for r in pages.page(df, 2, 2, {"kind": "x"}, "v", True, ["id"]).collect()] == [1]
    row = pages.total_pages(df, 2, {"kind": "all"}).first()
    assert (row.total, row.total_pages) == (4, 2) and pages.total_pages(df.limit(0), 2).first().total_pages == 1


def test_accepted_only_limit(spark):
    rows = [(1, i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 3, 10, 11])]
    df = spark.createDataFrame(rows, "k int, id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.id: (r.accepted, r.retry_after) for r in limits.rate_limited(df, "k", "ts", "id", limit=2, window_s=10).collect()}
    assert got == {0: (True, 0.0), 1: (True, 0.0), 2: (False, 8.0), 3: (False, 7.0), 4: (True, 0.0), 5: (True, 0.0)}
    seen = {r.id: r.in_window for r in limits.arrivals(df, "k", "ts", 10).collect()}
    assert seen[4] == 4 and seen[3] == 4


def test_ingest_skips_what_was_seen(spark, tmp_path):
    seen = []

    def process(fresh):
        seen.append(sorted(r.id for r in fresh.collect()))
        return fresh.where("id <> 2")

    at = [str(tmp_path / x) for x in ("ledger", "target")]
    for ids in ([1, 2], [2, 3]):
        limits.ingest_unseen(spark.createDataFrame([(i,) for i in ids], "id int"), "id", at[0], process, at[1])
    assert seen == [[1, 2], [3]] and sorted(r.id for r in limits.ingested(spark, *at).collect()) == [1, 3]


def test_retention(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:59:59")], "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.id for r in limits.expired(df, "ts", 7200, "2024-01-01 02:00:00").collect()] == [1]
