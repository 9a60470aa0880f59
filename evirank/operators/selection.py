"""Order-dependent choice of representatives, per group: leader clusters, MaxMin, promotion.

Rows of a group stand in the order of ``ord``; the first row of a repeated id counts.  Groups run in parallel, most of them
whole in a task.  Leader clusters of groups beyond ``IN_ONE_TASK`` rows are found by all tasks together, with the same
result (``leaders_by_rounds``).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialize
from .curation import dense_index
from .ranking import keep_first

#: Rows of a group that one task clusters by itself, and rows of a block of a larger one.
IN_ONE_TASK, BLOCK = 10_000, 4096

def tanimoto_matrix(words: np.ndarray, bits: np.ndarray, row: np.ndarray, row_bits: int) -> np.ndarray:
    shared = np.bitwise_count(words & row).sum(1).astype(np.int64)
    union = bits + row_bits - shared
    return np.divide(shared, union, out=np.zeros(len(words)), where=union > 0)


def leaders(words: np.ndarray, bits: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the index of its cluster's leader: the first leader that is like it, else itself."""
    out = np.arange(len(words))
    heads: list[int] = []
    for i in range(len(words)):
        like = tanimoto_matrix(words[heads], bits[heads], words[i], bits[i]) >= threshold if heads else np.zeros(0, bool)
        if like.any():
            out[i] = heads[int(like.argmax())]
        else:
            heads.append(i)
    return out


def maxmin(words: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Indices of n rows far apart, in order of choice: the first row, then always the one whose nearest
    chosen row is farthest (of equals the first)."""
    if not len(words) or n <= 0:
        return np.zeros(0, np.int64)
    chosen, far = [0], 1 - tanimoto_matrix(words, bits, words[0], bits[0])
    free = np.ones(len(words), bool)
    free[0] = False
    while len(chosen) < min(n, len(words)):
        at = int(np.where(free, far, -1.0).argmax())
        chosen.append(at)
        free[at] = False
        far = np.minimum(far, 1 - tanimoto_matrix(words, bits, words[at], bits[at]))
    return np.array(chosen)


def assign(words: np.ndarray, bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each row the chosen row most like it (of equals the earliest chosen)."""
    score = np.stack([tanimoto_matrix(words, bits, words[j], bits[j]) for j in chosen])
    return chosen[score.argmax(0)]


def promote(of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Each cluster's representative becomes its member with the highest value (the first of equals); a
    cluster without a value keeps its own."""
    out = of.copy()
    for head in np.unique(of):
        members = np.flatnonzero(of == head)
        v = value[members]
        if not np.isnan(v).all():
            out[members] = members[int(np.nanargmax(v))]
    return out


def choose(words: np.ndarray, bits: np.ndarray, limit: int, threshold: float) -> np.ndarray:
    """Leader clusters if the group has at most ``limit`` rows.  Else ``limit`` rows by MaxMin; if two of them
    are alike by the threshold, they are clustered once more.  Returns each row's representative."""
    if len(words) <= limit:
        return leaders(words, bits, threshold)
    chosen = maxmin(words, bits, limit)
    of = assign(words, bits, chosen)
    w, b = words[chosen], bits[chosen]
    best = max((tanimoto_matrix(w[i + 1 :], b[i + 1 :], w[i], b[i]).max(initial=0) for i in range(len(chosen) - 1)), default=0)
    if best >= threshold:
        head = dict(zip(chosen.tolist(), chosen[leaders(w, b, threshold)].tolist(), strict=True))
        of = np.array([head[x] for x in of])
    return of


def representatives(rows: DataFrame, group: str, method: str = "policy", threshold: float = 0.8, limit: int = 50) -> DataFrame:
    """group, id, rep_id, is_rep for every distinct id of a group.

    rows: the group column, id, ord, words, bitcount and value (may be null).  method: 'leader', 'maxmin'
    (``limit`` rows) or 'policy' (leaders up to ``limit`` rows, MaxMin beyond); then promotion by value.
    """
    if method not in ("leader", "maxmin", "policy"):
        raise ValueError(f"unknown method {method!r}")
    rows = rows.select(group, "id", "ord", "words", "bitcount", "value")
    if method == "leader":
        large = materialize(rows.groupBy(group).count().where(F.col("count") > IN_ONE_TASK).select(F.col(group).alias("__large")), "large")
        if not large.isEmpty():
            mine = F.col(group) == F.col("__large")
            clusters = leaders_by_rounds(rows.join(F.broadcast(large), mine, "left_semi"), group, threshold)
            return promoted(clusters, group).unionByName(_in_one_task(rows.join(F.broadcast(large), mine, "left_anti"), group, method, threshold, limit))
    return _in_one_task(rows, group, method, threshold, limit)


def _in_one_task(rows: DataFrame, group: str, method: str, threshold: float, limit: int) -> DataFrame:
    fields = {f.name: f.dataType for f in rows.schema}
    out = T.StructType().add(group, fields[group]).add("id", fields["id"]).add("rep_id", fields["id"]).add("is_rep", "boolean")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], kind="stable").drop_duplicates("id")
        words = np.array(pdf["words"].tolist(), np.int64).view(np.uint64).reshape(len(pdf), -1)
        bits = pdf["bitcount"].to_numpy(np.int64)
        if method == "leader":
            of = leaders(words, bits, threshold)
        elif method == "maxmin":
            of = assign(words, bits, maxmin(words, bits, limit))
        else:
            of = choose(words, bits, limit, threshold)
        of = promote(of, pdf["value"].to_numpy(np.float64))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({group: pdf[group].to_numpy(), "id": ids, "rep_id": ids[of], "is_rep": of == np.arange(len(ids))})

    return rows.groupBy(group).applyInPandas(run, out)


def _first_like(rows: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """place, first: for each row the smallest place among ``others`` of its group that is before its own and like it by the
    threshold; rows without one are left out.  Both sides: grp, place, words, bitcount, lo, hi (blocks of the group).

    Rows of a block meet those of each block of their group before it; a task compares two blocks and returns one number a
    row, so pairs never leave it."""
    a = rows.select("grp", "place", "words", "bitcount", F.floor(F.col("place") / BLOCK).alias("a"), F.explode(F.sequence("lo", F.floor(F.col("place") / BLOCK))).alias("b"))
    right_names = {c: f"r_{c}" for c in ("grp", "place", "words", "bitcount")}  # both sides may be one table
    b = others.select(*[F.col(c).alias(n) for c, n in right_names.items()], F.explode(F.sequence(F.floor(F.col("place") / BLOCK), "hi")).alias("a"), F.floor(F.col("place") / BLOCK).alias("b"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if left.num_rows and right.num_rows:
            left, right = left.sort_by("place"), right.rename_columns([n.removeprefix("r_") for n in right.column_names]).sort_by("place")
            (x, nx, px, gx), (y, ny, py, gy) = ((np.array(t.column("words").to_pylist(), np.int64).view(np.uint64), *(t.column(c).to_numpy() for c in ("bitcount", "place", "grp"))) for t in (left, right))
            for g in np.intersect1d(gx, gy):
                i, j = np.flatnonzero(gx == g), np.flatnonzero(gy == g)
                for at in range(0, len(i), 256):
                    k = i[at : at + 256]
                    shared = sum(np.bitwise_count(x[k, w, None] & y[None, j, w]).astype(np.int32) for w in range(x.shape[1]))
                    union = nx[k, None] + ny[None, j] - shared
                    like = (np.divide(shared, union, out=np.zeros(shared.shape), where=union > 0) >= threshold) & (py[None, j] < px[k, None])
                    some = like.any(1)
                    found.append((px[k][some], py[j][like[some].argmax(1)]))
        place, first = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"place": place, "first": first})

    pairs = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(run, "place long, first long")
    return pairs.groupBy("place").agg(F.min("first").alias("first"))


def leaders_by_rounds(rows: DataFrame, group: str, threshold: float) -> DataFrame:
    """group, id, place, value, leader (a place): the clusters of ``leaders`` for groups of any size.

    The leaders are the first maximal set of rows of which no two are alike: a row leads if no earlier row that still may
    lead is like it.  Each round all such rows become leaders at once and the rows like them are settled, which leaves what
    the sequential order would; the number of rounds is the longest chain of rows that wait for each other, small for rows
    in no particular order.  Then each row joins the first leader that is like it.  Equal vectors are taken once.  Nothing
    is gathered: a task holds two blocks of ``BLOCK`` rows.  The rows that are compared are all pairs of a group, as in
    the sequential form; what leaves a task is one number a row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    whole = keep_first(rows.where("id is not null"), [group, "id"], [F.asc("ord")])
    placed = materialize(dense_index(whole, [group, "ord", "id"], "place"), "placed")
    # rows without a bit are like none, not even each other
    key = [F.col(group), F.col("words"), F.when(F.col("bitcount") == 0, F.col("place"))]
    firsts = placed.groupBy(*[k.alias(n) for k, n in zip(key, ("__g", "__w", "__z"), strict=True)]).agg(F.min("place").alias("__first"), F.first("bitcount").alias("__n"))
    spans = placed.groupBy(F.col(group).alias("__group")).agg(F.min("place").alias("grp"), F.floor(F.min("place") / BLOCK).alias("lo"), F.floor(F.max("place") / BLOCK).alias("hi"))
    distinct = firsts.join(spans, F.col("__g").eqNullSafe(F.col("__group"))).select("grp", F.col("__first").alias("place"), F.col("__w").alias("words"), F.col("__n").alias("bitcount"), "lo", "hi")
    distinct = materialize(distinct, "distinct")
    left, chosen = distinct, []
    while not left.isEmpty():
        waiting = _first_like(left, left, threshold).select("place")
        new = materialize(left.join(waiting, "place", "left_anti"), "leaders")
        chosen.append(new)
        rest = left.join(new.select("place"), "place", "left_anti")
        left = materialize(rest.join(_first_like(rest, new, threshold).select("place"), "place", "left_anti"), "left")
    if not chosen:
        return placed.select(group, "id", "place", "value", F.col("place").alias("leader"))
    heads = reduce(DataFrame.union, chosen)
    of = distinct.join(_first_like(distinct, heads, threshold).withColumnRenamed("first", "leader"), "place", "left").select(F.col("place").alias("__first"), F.coalesce("leader", "place").alias("leader"))
    own = placed.join(firsts, _same(key)).join(of, "__first")
    return own.select(group, "id", "place", "value", "leader")


def _same(key: list[Column]) -> Column:
    """Rows of equal group and vector, nulls equal."""
    return reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(n)) for k, n in zip(key, ("__g", "__w", "__z"), strict=True)])


def promoted(clusters: DataFrame, group: str) -> DataFrame:
    """group, id, rep_id, is_rep: each cluster's representative is its member of the highest value (the first of equals), its
    leader if none has a value.  clusters: group, id, place, value, leader."""
    value = F.col("value").cast("double")
    heads = clusters.groupBy(F.col("leader").alias("__leader")).agg(
        F.min(F.when(F.col("place") == F.col("leader"), F.col("id"))).alias("__own"), F.max(value.isNotNull() & ~F.isnan(value)).alias("__any"),
        F.min(F.when(value.isNotNull() & ~F.isnan(value), F.struct((-value).alias("less"), "place", "id"))).alias("__best"),
    )
    rows = clusters.join(heads, F.col("leader") == F.col("__leader")).withColumn("rep_id", F.when(F.col("__any"), F.col("__best.id")).otherwise(F.col("__own")))
    return rows.select(group, "id", "rep_id", (F.col("id") == F.col("rep_id")).alias("is_rep"))
