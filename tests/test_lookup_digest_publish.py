"""Lookup by key, table fingerprints, published versions, and a cache whose appends can be repeated."""

from __future__ import annotations

import json
import os
import socket
import time

import pytest
from pyspark.sql import functions as F

from evirank.functions.digest import row_sums, table_fingerprint
from evirank.functions.files import Folder
from evirank.plans import cache as caches
from evirank.plans.cache import Cache, Request, best_entries, covers, select, signature_of
from evirank.sources import lookup, writers


def scan_metric(df, metric: str) -> list[int]:
    """A metric of each file scan of a plan that ran."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        elif name.startswith("Scan parquet") and p.metrics().contains(metric):
            found.append(p.metrics().apply(metric).value())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_asked_keys_prune_the_files(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lookup, "BROADCAST_KEYS", 0)
    path = str(tmp_path / "t")
    rows = spark.range(5000).select(F.concat(F.lit("P"), F.col("id") % 700).alias("uniprot_id"), "id").union(spark.createDataFrame([(None, -1)], "uniprot_id string, id long"))
    lookup.write_lookup(rows, path, "uniprot_id", 32)
    files = sum(len([f for f in names if f.endswith(".parquet")]) for _, _, names in os.walk(path))
    assert files >= 32
    ids = spark.createDataFrame([("P1",), ("P2",), ("P2",), ("none",), (None,)], "x string")
    got = lookup.lookup(spark, path, ids, "uniprot_id")
    assert got.columns == ["uniprot_id", "id"]
    assert sorted(r.id for r in got.collect()) == sorted(i for i in range(5000) if i % 700 in (1, 2))
    assert 0 < max(scan_metric(got, "numFiles")) <= 4 < files
    assert lookup.lookup(spark, path, ids.limit(0), "uniprot_id").count() == 0


def test_a_frequent_key_is_several_files(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        lookup.write_lookup(rows, str(tmp_path / "hot"), "k", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = [len([f for f in os.listdir(tmp_path / "hot" / b) if f.endswith(".parquet")]) for b in os.listdir(tmp_path / "hot") if b.startswith("bucket")]
    assert max(sizes) > 1
    asked = spark.createDataFrame([(7,), (9,)], "k int")  # another type than the table's
    assert lookup.lookup(spark, str(tmp_path / "hot"), asked, "k").count() == 40_001


def test_fingerprint_follows_rows_only(spark, tmp_path):
    rows = [(1, "a", 1.5, [1, 2], {"x": 1, "y": 2}), (2, None, None, None, None), (2, None, None, None, None), (3, "", float("nan"), [], {})]
    schema = "id long, s string, d double, l array<int>, m map<string,int>"
    df = spark.createDataFrame(rows, schema)
    want = table_fingerprint(df)
    assert table_fingerprint(df.repartition(7)) == want == table_fingerprint(df.orderBy(F.desc("id")).select("m", "l", "d", "s", "id"))
    df.write.parquet(str(tmp_path / "t"))
    assert table_fingerprint(spark.read.parquet(str(tmp_path / "t"))) == want
    assert table_fingerprint(spark.createDataFrame([(1, "a", 1.5, [1, 2], {"y": 2, "x": 1}), *rows[1:]], schema)) == want
    others = [rows[:-1], [*rows, rows[0]], [(1, "a", 1.5, [2, 1], {"x": 1, "y": 2}), *rows[1:]], [*rows[:3], (3, None, float("nan"), [], {})], [(1, "a", 1.5, [1, 2], {"x": 2, "y": 1}), *rows[1:]], []]
    found = {table_fingerprint(spark.createDataFrame(r, schema)) for r in others} | {table_fingerprint(df.withColumnRenamed("s", "t")), table_fingerprint(df.withColumn("id", F.col("id").cast("int")))}
    assert len(found | {want}) == len(others) + 3
    # two nulls in other columns differ, though both are skipped by the hash
    two = lambda *r: table_fingerprint(spark.createDataFrame([r], "a string, b string"))
    assert two(None, "x") != two("x", None)
    assert {r.id: r.n_rows for r in row_sums(df, ["id"]).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_failed_publish_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "rep")
    with pytest.raises(ValueError):
        writers.published(spark, path)
    first = writers.publish(spark.range(3).toDF("id"), path)
    with pytest.raises(Exception, match="broken"):
        writers.publish(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert writers.published(spark, path).count() == 3
    second = writers.publish(spark.range(5).toDF("id"), path)
    assert writers.published(spark, path).count() == 5 and {first, second} <= set(os.listdir(path))
    os.makedirs(f"{path}/.staging-v-left")
    assert sorted(writers.drop_old_versions(spark, path)) == sorted([first, ".staging-v-left"])
    assert writers.published(spark, path).count() == 5


class Crash(RuntimeError):
    pass


def ids_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "uniprot_id string")


def compute(needed):
    return needed.where("uniprot_id <> 'none'").select("uniprot_id", F.explode(F.array(F.lit("l1"), F.lit("l2"))).alias("target_id"), F.lit(0.6).alias("tanimoto"))


def test_a_crash_between_the_writes_leaves_each_row_once(spark, tmp_path, monkeypatch):
    cache, want = Cache(spark, str(tmp_path / "c")), Request({"metric": "x"}, 0.4)
    assert cache.fetch(want, ids_of(spark, "a", "none"), compute).count() == 2
    name = want.namespace()

    def crash(self):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Cache, "_between_writes", crash)
        with pytest.raises(Crash):
            cache.fetch(want, ids_of(spark, "a", "b", "c"), compute)
    assert cache.missing(name, ids_of(spark, "b", "c")) == 2
    # rows of the unfinished batch are there, but do not count
    assert spark.read.parquet(str(tmp_path / "c" / name / "hits")).count() == 6
    assert cache.hits(name, want, ids_of(spark, "a", "b", "c")).count() == 2
    # another batch that overlaps the lost one, then the lost one again: each row once
    assert cache.fetch(want, ids_of(spark, "c", "d"), compute).count() == 4
    assert cache.fetch(want, ids_of(spark, "a", "b", "c"), compute).count() == 6
    rows = [tuple(r) for r in cache.hits(name, want, ids_of(spark, "a", "b", "c", "d", "none")).collect()]
    assert len(rows) == len(set(rows)) == 8
    assert len(cache.drop_unfinished(name)) == 1 and cache.drop_unfinished(name) == []
    assert cache.hits(name, want, ids_of(spark, "a", "b", "c", "d")).count() == 8


def test_the_same_batch_replaces_itself(spark, tmp_path):
    cache, want = Cache(spark, str(tmp_path / "c")), Request({}, 0.4)
    cache.fetch(want, ids_of(spark, "a"), compute)
    name, more = want.namespace(), ids_of(spark, "b", "c")
    once = cache.append(name, more, compute(more))
    again = cache.append(name, more.orderBy(F.desc("uniprot_id")).repartition(3), compute(more))
    assert once == again and cache.hits(name, want, ids_of(spark, "a", "b", "c")).count() == 6
    cache.append(name, ids_of(spark, "b"), compute(ids_of(spark, "b")))  # a batch that overlaps: one of them counts
    assert cache.hits(name, want, ids_of(spark, "b")).count() == 2
    cache.append(name, ids_of(spark, "e"), compute(ids_of(spark, "e")).limit(0))
    assert cache.missing(name, ids_of(spark, "e")) == 0


def test_a_start_that_failed_is_started_again(spark, tmp_path, monkeypatch):
    cache, want = Cache(spark, str(tmp_path / "c")), Request({}, 0.4)

    def broken(needed):
        raise Crash

    with pytest.raises(Crash):
        cache.fetch(want, ids_of(spark, "a"), broken)
    with monkeypatch.context() as m:
        m.setattr(Folder, "write", lambda *a: (_ for _ in ()).throw(Crash()))
        with pytest.raises(Crash):
            cache.fetch(want, ids_of(spark, "a"), compute)  # both tables, no manifest
    assert cache.entries() == [] and cache.fetch(want, ids_of(spark, "b"), compute).count() == 2
    assert cache.hits(want.namespace(), want, ids_of(spark, "a", "b")).count() == 2


def test_locks(spark, tmp_path, monkeypatch):
    cache = Cache(spark, str(tmp_path / "c"))
    lock = tmp_path / "c" / "x.lock"
    lock.parent.mkdir()
    held = lambda **k: lock.write_text(json.dumps({"owner": "o", "host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + 99} | k))
    for living in ({}, {"host": "elsewhere", "pid": 2**22 + 1}, {"pid": 1}):  # process 1 may be another user's
        held(**living)
        with pytest.raises(TimeoutError), cache.lock("x", 0.5):
            pass
    for gone in ({"pid": 2**22 + 1}, {"until": time.time() - 1}):
        held(**gone)
        with cache.lock("x", 5):
            assert json.loads(lock.read_text())["owner"] != "o"
        assert not lock.exists()
    monkeypatch.setattr(caches, "LEASE", 0.6)
    with cache.lock("x"):
        first = json.loads(lock.read_text())["until"]
        time.sleep(1)
        assert json.loads(lock.read_text())["until"] > first
        with pytest.raises(TimeoutError), Cache(spark, str(tmp_path / "c")).lock("x", 0.8):
            pass


def test_changed_data_make_another_entry(spark, tmp_path):
    cache, data = Cache(spark, str(tmp_path / "c")), spark.range(4).withColumn("v", F.lit("x"))
    old = Request(signature_of({"t": data}, metric="x"), 0.4)
    cache.fetch(old, ids_of(spark, "a"), compute)
    same = Request(signature_of({"t": data.repartition(3)}, metric="x"), 0.5)
    new = Request(signature_of({"t": data.withColumn("v", F.when(F.col("id") == 2, "y").otherwise(F.col("v")))}, metric="x"), 0.4)
    assert cache.find(same, ids_of(spark, "a")) == old.namespace() and cache.find(new, ids_of(spark, "a")) is None
    cache.fetch(new, ids_of(spark, "a"), compute)
    assert len(cache.entries()) == 2 and cache.drop_stale(new.signature) == [old.namespace()]
    assert [n for n, _ in cache.entries()] == [new.namespace()]


def test_a_table_of_requests_chooses_as_select_does(spark):
    bands = [(i, "m" if i % 5 else "n", i % 4 / 10, (4 + i // 4 % 4) / 10 if i // 4 % 4 else None, i % 3) for i in range(40)]
    entries = spark.createDataFrame([b for b in bands if b[0] % 2], "entry_id int, signature string, minimum double, maximum double, n_done int")
    wants = spark.createDataFrame([b[:4] for b in bands], "want_id int, signature string, minimum double, maximum double")
    held = [(b[0], Request({"s": b[1]}, b[2], b[3]), b[4]) for b in bands if b[0] % 2]
    got = {r.want_id: r.entry_id for r in best_entries(entries, wants).collect()}
    for b in bands:
        want = Request({"s": b[1]}, b[2], b[3])
        at = select([(r, n) for _, r, n in held], want)
        assert got[b[0]] == (None if at is None else held[at][0])
        assert got[b[0]] is None or covers(next(r for i, r, _ in held if i == got[b[0]]), want)
