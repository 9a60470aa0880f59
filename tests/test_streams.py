"""Streams against their batch forms: shuffled late input, restarts after crashes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evirank.streaming import limits


def files_of(spark, rows, schema, path, n):
    """The rows dealt over n files in the order of the list."""
    for i, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        spark.createDataFrame([rows[j] for j in part], schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(path)
        _touch_in_order(path, i)


def _touch_in_order(path, i):
    """The file source takes files by their time."""
    import glob
    import os

    newest = max(glob.glob(f"{path}/*.parquet"), key=os.path.getctime)
    os.utime(newest, (1_700_000_000 + i, 1_700_000_000 + i))


def run(df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start()
    q.awaitTermination(170)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.read.parquet(str(tmp_path / f"{name}-out"))


@pytest.fixture()
def late(spark, tmp_path):
    """Requests of four keys, shuffled by up to 100 s, ties and instants of the same millisecond among them; then a row far
    ahead that lets the watermark pass all others."""
    rng = np.random.default_rng(4)
    start = 1_700_000_000_000_000
    us = start + rng.integers(0, 900, 300) * 1_000_000 + rng.choice([0, 0, 1, 999], 300)
    rows = sorted(((int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 300), us, strict=True))), key=lambda r: r[2] + int(rng.integers(-50, 50)) * 1_000_000)
    ahead = [(99, 1000 + i, start + 100_000 * 1_000_000 * (i + 1)) for i in range(2)]
    files_of(spark, rows + ahead, "k int, id int, us long", str(tmp_path / "in"), 6)
    table = spark.read.parquet(str(tmp_path / "in"))
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_late_requests_are_admitted_as_in_the_batch(spark, tmp_path, late):
    table, stream = late
    got = run(limits.rate_limited_stream(stream, "k", "ts", "id", limit=3, window_s=60, late_s=120), tmp_path, "limit").where("k < 99").collect()
    want = limits.rate_limited(table, "k", "ts", "id", limit=3, window_s=60).where("k < 99").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)
    assert {r.accepted for r in got} == {True, False}


def test_rows_expire_when_the_watermark_passes_them(spark, tmp_path, late):
    table, stream = late
    got = {r.k: (r.ts, r.expired_at) for r in run(limits.expired_stream(stream, "k", "ts", 7200, 120), tmp_path, "ttl").where("k < 99").collect()}
    want = {r.k: r.ts for r in table.where("k < 99").groupBy("k").agg(F.max("ts").alias("ts")).collect()}
    assert {k: ts for k, (ts, _) in got.items()} == want
    assert all((end - ts).total_seconds() == 7200 for ts, end in got.values())


class Crash(RuntimeError):
    pass


def some(fresh):
    """No row for id 2, two for others."""
    return fresh.where("id <> 2").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))


@pytest.mark.parametrize("batch", [None, "s-0"])
@pytest.mark.parametrize("at", [1, 2])
def test_an_ingest_that_crashed_is_repeated(spark, tmp_path, monkeypatch, batch, at):
    ids, paths = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id int"), [str(tmp_path / x) for x in ("ledger", "target")]
    limits.ingest_unseen(spark.createDataFrame([(9,)], "id int"), "id", paths[0], some, paths[1], "s-before" if batch else None)
    write, calls = limits._batch, []

    def crash(rows, path, name):  # after the target, or after the ledger
        write(rows, path, name)
        calls.append(path)
        if len(calls) == at:
            raise Crash

    with monkeypatch.context() as m:
        m.setattr(limits, "_batch", crash)
        with pytest.raises(Crash):
            limits.ingest_unseen(ids, "id", paths[0], some, paths[1], batch)
    rows = lambda: sorted(tuple(r) for r in limits.ingested(spark, *paths).collect())
    before = [(9, 1), (9, 2)]
    assert rows() == before if at == 1 else rows() == [(1, 1), (1, 2), (3, 1), (3, 2), *before]
    for _ in range(2):
        limits.ingest_unseen(ids, "id", paths[0], some, paths[1], batch)
        assert rows() == [(1, 1), (1, 2), (3, 1), (3, 2), *before]
    limits.ingest_unseen(spark.createDataFrame([(3,), (4,)], "id int"), "id", paths[0], some, paths[1], "s-1" if batch else None)
    assert rows() == [(1, 1), (1, 2), (3, 1), (3, 2), (4, 1), (4, 2), *before]


@pytest.mark.parametrize("at", [2, 3, 4])
def test_progressive_results_after_a_restart(spark, tmp_path, monkeypatch, at):
    rows = [(f"q{i % 11}", i, i) for i in range(40)]
    files_of(spark, rows, "qseqid string, id int, us long", str(tmp_path / "in"), 4)
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hits = spark.createDataFrame([(f"q{i % 13}", i) for i in range(60)], "qseqid string, hit int")
    compute = lambda asked: hits.join(asked, "qseqid", "left_semi")
    path, ck, write, calls = str(tmp_path / "p"), str(tmp_path / "ck"), limits._batch, []
    assert limits.progress(spark, path, table).first().n_finished == 0

    def crash(rows, path, name):
        write(rows, path, name)
        calls.append(path)
        if len(calls) == at:
            raise Crash

    with monkeypatch.context() as m:
        m.setattr(limits, "_batch", crash)
        q = limits.progressive(stream(), compute, path, ck)
        with pytest.raises(Exception, match="Crash"):
            q.awaitTermination(100)
    part = limits.progress(spark, path, table).first()
    assert 0 < part.n_finished <= part.n_asked == 11
    seen = limits.results_so_far(spark, path)
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, compute(spark.createDataFrame(seen.select("qseqid").distinct().collect(), "qseqid string")).collect()))
    again = limits.progressive(stream(), compute, path, ck)
    assert again.awaitTermination(100)
    got = [tuple(r) for r in limits.results_so_far(spark, path).collect()]
    assert sorted(got) == sorted(tuple(r) for r in compute(table).collect()) and len(got) > 20
    assert limits.progress(spark, path, table).first().share == 1.0
