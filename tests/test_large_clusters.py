"""Leader clusters by rounds equal the sequential ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from evirank.operators import selection


def group_rows(rng, g, n):
    """Rows of one group, some alike, some equal, some without a bit; order and values of their own."""
    bits = (rng.random((n, 24)) < rng.choice([0.2, 0.5, 0.8])).astype(np.uint8)
    for i in range(n):
        if i and rng.random() < 0.4:
            bits[i] = bits[int(rng.integers(i))]
            if rng.random() < 0.6:
                bits[i, int(rng.integers(24))] ^= 1
        if rng.random() < 0.05:
            bits[i] = 0
    words = np.packbits(np.pad(bits, ((0, 0), (0, 104))), axis=1, bitorder="little").view(np.int64)
    order = rng.permutation(n)
    return [(g, int(order[i]) * 7 % 101 + 1000 * i, int(order[i]), words[i].tolist(), int(bits[i].sum()), None if rng.random() < 0.5 else float(rng.integers(0, 4))) for i in range(n)]


SCHEMA = "grp string, id long, ord int, words array<long>, bitcount int, value double"


def compare(spark, rows, threshold, monkeypatch, block):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = {(r.grp, r.id): (r.rep_id, r.is_rep) for r in selection.representatives(df, "grp", "leader", threshold).collect()}
    monkeypatch.setattr(selection, "BLOCK", block)
    monkeypatch.setattr(selection, "IN_ONE_TASK", 0)
    got = selection.representatives(df, "grp", "leader", threshold).collect()
    assert {(r.grp, r.id): (r.rep_id, r.is_rep) for r in got} == want and len(got) == len(want)


def test_a_thousand_groups_equal_the_sequential_form(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [r for g in range(1000) for r in group_rows(rng, f"g{g}", int(rng.integers(1, 14)))]
    compare(spark, rows, 0.6, monkeypatch, 64)


def test_groups_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [r for g, n in (("a", 150), ("b", 1), ("c", 40), (None, 30)) for r in group_rows(rng, g, n)]
    rows += [("c", rows[160][1], 5, rows[160][3], rows[160][4], None)]  # an id again
    rows = [r for r in rows if r[0] is not None]
    compare(spark, rows, 0.5, monkeypatch, 8)


def test_a_large_group_is_clustered_by_many_tasks(spark, monkeypatch):
    """100,000 rows of one group beside small ones; 40 families around far centres in no particular order."""
    n, rng = 100_000, np.random.default_rng(3)
    centres = rng.integers(-(2**62), 2**62, (40, 4))
    base = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "c int, centre array<long>")
    rows = spark.range(n).withColumn("c", (F.xxhash64("id") % 40 + 40) % 40).join(F.broadcast(base), "c")
    # up to one bit of the first word differs from the centre
    flip = F.when(F.col("id") % 9 == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 60).cast("int")))
    words = F.transform("centre", lambda x, i: F.when(i == 0, x.bitwiseXOR(flip)).otherwise(x))
    rows = rows.select(F.lit("big").alias("grp"), "id", F.xxhash64("id", F.lit(1)).alias("ord"), words.alias("words"), F.lit(None).cast("double").alias("value"))
    rows = rows.withColumn("bitcount", F.aggregate("words", F.lit(0), lambda a, x: a + F.bit_count(x)))
    small = rows.where("id < 30").withColumn("grp", F.lit("small"))
    got = selection.representatives(rows.unionByName(small), "grp", "leader", 0.9)
    big = got.where("grp = 'big'")
    found = {r.rep_id: r.n for r in big.groupBy("rep_id").agg(F.count("*").alias("n")).collect()}
    family = {r.c: (r.n, r.first) for r in spark.range(n).select(((F.xxhash64("id") % 40 + 40) % 40).alias("c"), "id").groupBy("c").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(1))).alias("first")).collect()}
    assert found == {first: size for size, first in family.values()}
    assert got.where("grp = 'small'").count() == 30
