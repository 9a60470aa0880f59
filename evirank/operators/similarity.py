"""Similarity search over packed bit vectors (Tanimoto) and dense vectors (cosine).

A packed vector is an array of longs (column words) with its number of ones (column bitcount).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scratch import materialize
from .ranking import keep_first, order, top_n

METRICS = ("tanimoto", "cosine")


def packed(bits: Column) -> Column:
    """Array of booleans or 0/1 integers to longs, first element in the lowest bit; any length."""
    n = F.size(bits)
    word = lambda at: F.aggregate(
        F.slice(F.transform(bits, lambda x, i: F.when(x.cast("int") == 1, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("long"))), at * 64 + 1, F.lit(64)),
        F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 64).cast("int")), word)).otherwise(F.array().cast("array<long>"))


def bitcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, x: acc + F.bit_count(x))


def shared_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)


def tanimoto(shared: Column, a: Column, b: Column) -> Column:
    """Shared ones over all ones; 0 if there are none."""
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0)


def cosine(a: Column, b: Column, normalized: bool = False) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    if normalized:
        return dot(a, b)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def check_metric(metric: str, seed: dict, target: dict) -> None:
    """Raises ValueError unless both sides' descriptions (packed, dim, dtype) suit the metric."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}: one of {METRICS}")
    for side in (seed, target):
        if bool(side.get("packed")) != (metric == "tanimoto"):
            raise ValueError(f"{metric} takes {'packed' if metric == 'tanimoto' else 'dense'} vectors")
    if seed.get("dim") != target.get("dim"):
        raise ValueError(f"dimensions differ: {seed.get('dim')} and {target.get('dim')}")


def _least_shared(threshold: float, most: int) -> np.ndarray:
    """For each sum of two bit counts up to ``most`` the smallest number of shared ones that reaches the threshold, by the
    same division as the score's."""
    total = np.arange(most + 1)
    out = np.full(most + 1, np.iinfo(np.int32).max, np.int32)
    guess = np.floor(threshold * total / (1 + threshold)).astype(np.int64) - 1
    for k in (guess + step for step in (3, 2, 1, 0)):  # the smallest last
        k = np.maximum(k, 0)
        ok = (total > k) & (np.divide(k, total - k, out=np.zeros(len(k)), where=total > k) >= threshold)
        out[ok] = k[ok]
    return out


def _best_of_row(value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest values, of equals the first, in order of place."""
    if len(value) <= k:
        return np.arange(len(value))
    last = np.partition(value, len(value) - k)[len(value) - k]
    above, equal = np.flatnonzero(value > last), np.flatnonzero(value == last)
    return np.sort(np.concatenate((above, equal[: k - len(above)])))


def _close(x: np.ndarray, nx: np.ndarray, ox: np.ndarray, y: np.ndarray, ny: np.ndarray, oy: np.ndarray, threshold: float, maximum: float | None, per_query: int | None, other_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, Tanimoto) of the pairs in the band; of each row of x the first ``per_query``."""
    least = _least_shared(threshold, int(nx.max() + ny.max()))
    wide = np.uint8 if x.shape[1] <= 3 else np.int32
    needs = {n: np.minimum(least[n + ny], np.iinfo(wide).max).astype(wide) for n in np.unique(nx).tolist()}
    found = []
    for at in range(0, len(x), 16):
        part = slice(at, at + 16)
        shared = np.bitwise_count(x[part, None, 0] & y[None, :, 0]).astype(wide, copy=False)
        for w in range(1, x.shape[1]):
            shared += np.bitwise_count(x[part, None, w] & y[None, :, w])
        i, j = np.nonzero(shared >= np.stack([needs[n] for n in nx[part].tolist()]))
        both = shared[i, j].astype(np.int64)
        i += at
        value = both / (nx[i] + ny[j] - both)
        ok = np.ones(len(i), bool) if maximum is None else value <= maximum
        if other_ids:
            ok &= ox[i] != oy[j]
        i, j, value = i[ok], j[ok], value[ok]
        if per_query is not None and len(i):
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            kept = np.concatenate([a + _best_of_row(value[a:b], per_query) for a, b in zip(first, np.append(first[1:], len(i)), strict=True)])
            i, j, value = i[kept], j[kept], value[kept]
        found.append((i, j, value))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


#: Rows of a block of packed vectors.
PACKED_BLOCK = 16_384
#: Cells that the values of ``within`` are dealt into.
WITHIN_CELLS = 64


def _packed_cells(rows: DataFrame, id_column: str, side: str, threshold: float, within: list[str]) -> DataFrame:
    """id, its side's words, bitcount, own (a hash of the id), grp (a hash of ``within``), cell, n_words and bin.

    Bins are steps of the logarithm of the bit count, as wide as the threshold's: t |a| <= |b| <= |a| / t (Swamidass and
    Baldi, 2007), so only vectors of one bin or of neighbouring ones can reach it.  The step is a millionth wider, for rounding."""
    step = max(-math.log(threshold), 1e-3) * (1 + 1e-6)
    some = rows.where("bitcount > 0 and size(words) > 0 and not exists(words, x -> x is null)")
    for c in within:
        some = some.where(F.col(c).isNotNull())
    grp = F.xxhash64(*within) if within else F.lit(0).cast("long")
    own = F.col("__own") if "__own" in rows.columns else F.xxhash64(id_column)
    return some.select(
        F.col(id_column).alias("id"), F.col("words").alias(f"{side}_words"), F.col("bitcount").cast("long").alias("bitcount"), own.alias("own"), grp.alias("grp"), F.pmod(grp, F.lit(WITHIN_CELLS)).cast("int").alias("cell"),
        F.size("words").alias("n_words"), F.floor(F.log("bitcount") / step).cast("int").alias(f"{side}_bin"),
    )


def _met(cells: DataFrame, pairs: DataFrame, side: str, other: str) -> DataFrame:
    """Rows with each pair of blocks that theirs is part of."""
    key = ["cell", "n_words", f"{side}_bin"]
    rows = cells.join(pairs, key).withColumn(f"{side}_sub", F.pmod(F.xxhash64("own", f"{side}_words"), F.col(f"{side}_n")).cast("int"))
    return rows.withColumn(f"{other}_sub", F.explode(F.sequence(F.lit(0), F.col(f"{other}_n") - 1))).drop("s_n", "t_n")


def tanimoto_join(seeds: DataFrame, targets: DataFrame, threshold: float, maximum: float | None = None, per_query: int | None = None, within: list[str] = (), other_ids: bool = False) -> DataFrame:
    """query_id, target_id, tanimoto: all pairs with threshold <= Tanimoto (<= maximum); with ``per_query`` the best of each
    query_id (ties: the smallest target_id).

    Both sides are dealt into cells of similar bit counts and those into blocks of about ``PACKED_BLOCK`` rows; a task
    compares one block of seeds with one of targets and returns the pairs in the band, of each seed ``per_query`` at most.
    So memory is that of two blocks, whatever the sizes and however often a bit count occurs.

    seeds: query_id, words, bitcount.  targets: target_id, words, bitcount.  ``within``: columns of both sides in which a
    pair must agree (by a 64-bit hash).  other_ids: only pairs of different ids (or of different ``__own``, a long
    column of both sides that stands for them).  With ``per_query``, target_id must be of a kind that Arrow sorts.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if per_query is not None and per_query <= 0:
        per_query, seeds = 1, seeds.limit(0)
    within = list(within)
    kinds = [T.StructField("query_id", seeds.schema["query_id"].dataType), T.StructField("target_id", targets.schema["target_id"].dataType)]
    out = T.StructType([*kinds]).add("tanimoto", "double")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds] + [("tanimoto", pa.float64())])
    s, t = _packed_cells(seeds, "query_id", "s", threshold, within), _packed_cells(targets, "target_id", "t", threshold, within)
    blocks = lambda rows, side: rows.groupBy("cell", "n_words", f"{side}_bin").agg(F.ceil(F.count("*") / PACKED_BLOCK).cast("int").alias(f"{side}_n"))
    near = F.explode(F.sequence(F.col("s_bin") - 1, F.col("s_bin") + 1)).alias("t_bin")
    pairs = materialize(blocks(s, "s").select("*", near).join(blocks(t, "t"), ["cell", "n_words", "t_bin"]), "blocks")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        if per_query is not None:
            right = right.take(pc.sort_indices(right.column("id")))  # a row's place is its rank by id
        (x, nx, ox, gx), (y, ny, oy, gy) = (
            (side.column(words).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(side.num_rows, -1), *(side.column(c).to_numpy() for c in ("bitcount", "own", "grp"))) for side, words in ((left, "s_words"), (right, "t_words"))
        )
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        order_x, order_y = np.argsort(gx, kind="stable"), np.argsort(gy, kind="stable")
        sorted_x, sorted_y = gx[order_x], gy[order_y]
        for g in np.intersect1d(gx, gy):
            i, j = (o[np.searchsorted(v, g, "left") : np.searchsorted(v, g, "right")] for o, v in ((order_x, sorted_x), (order_y, sorted_y)))
            a, b, value = _close(x[i], nx[i], ox[i], y[j], ny[j], oy[j], threshold, maximum, per_query, other_ids)
            found.append((i[a], j[b], value))
        mine, theirs, value = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table([left.column("id").take(pa.array(mine)), right.column("id").take(pa.array(theirs)), pa.array(value)], schema=arrow)

    key = ["cell", "n_words", "s_bin", "s_sub", "t_bin", "t_sub"]
    hits = _met(s, pairs, "s", "t").groupBy(*key).cogroup(_met(t, pairs, "t", "s").groupBy(*key)).applyInArrow(score, out)
    return top_k(hits, "tanimoto", per_query)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows; a null element is NaN."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(lists), -1)


#: More than a matrix product and a sum in order differ by for vectors of length 1.
SLACK = 1e-9
#: Scores that are held at a time, and pairs that are summed at a time.
AT_ONCE = 1 << 20


def _dots(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of q with rows j of x, sums in a fixed order: the same in any block."""
    step = max(1, AT_ONCE // max(q.shape[1], 1))
    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", q[i[a : a + step]], x[j[a : a + step]]) for a in range(0, len(i), step))])


def _near(q: np.ndarray, x: np.ndarray, threshold: float, maximum: float | None, per_query: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, similarity) of the pairs in the band; of each row of q the best ``per_query``, of equals the
    first in order of place.  A matrix product finds what may be in the band or among the best, sums in order decide."""
    top = math.inf if maximum is None else maximum
    found = []
    for at in range(0, len(q), step := max(1, AT_ONCE // len(x))):
        scores = q[at : at + step] @ x.T
        may = (scores >= threshold - SLACK) & (scores <= top + SLACK)
        if per_query is not None:
            edge = may & ((scores <= threshold + SLACK) | (scores >= top - SLACK))  # these may turn out to be outside
            for r in np.flatnonzero(may.sum(1) > (most := per_query + edge.sum(1))):
                inside = scores[r][may[r]]
                may[r] &= scores[r] >= np.partition(inside, len(inside) - most[r])[len(inside) - most[r]] - 2 * SLACK
        i, j = np.nonzero(may)
        i += at
        value = _dots(q, x, i, j)
        ok = (value >= threshold) & (value <= top)
        i, j, value = i[ok], j[ok], value[ok]
        if per_query is not None and len(i):
            by = np.lexsort((j, -value, i))
            i, j, value = i[by], j[by], value[by]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < per_query
            i, j, value = i[kept], j[kept], value[kept]
        found.append((i.astype(np.int32), j.astype(np.int32), value))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _cells(rows: DataFrame, id_column: str, pivots: np.ndarray, block: int) -> DataFrame:
    """id, vec, cell (its nearest pivot), angle (to it) and sub: a cell's rows are dealt into blocks of about ``block``."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if b.num_rows:
                x = _units(_matrix(b.column(1)))
                near = np.einsum("td,pd->tp", x, sent.value)
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "vec", "cell", "angle"])

    out = T.StructType([T.StructField("id", rows.schema[id_column].dataType), T.StructField("vec", rows.schema["vec"].dataType)]).add("cell", "integer").add("angle", "double")
    placed = materialize(rows.where(F.col(id_column).isNotNull() & F.col("vec").isNotNull()).select(id_column, "vec").mapInArrow(run, out), "cells")
    subs = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("__n"))
    return placed.join(F.broadcast(subs), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int")).drop("__n")


def _grid(seeds: DataFrame, query: str, targets: DataFrame, target: str, s_blocks: int, t_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of one cell, dealt into blocks that all meet."""
    sides = []
    for rows, column, own, n, other, m in ((seeds, query, "s_sub", s_blocks, "t_sub", t_blocks), (targets, target, "t_sub", t_blocks, "s_sub", s_blocks)):
        some = rows.where(F.col(column).isNotNull() & F.col("vec").isNotNull())
        sub = F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(own)
        sides.append(some.select(F.lit(0).alias("s_cell"), F.lit(0).alias("t_cell"), sub, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.col(column).alias("id"), "vec"))
    return sides[0], sides[1]


def block_pairs(seeds: DataFrame, targets: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """s_cell, s_sub, t_cell, t_sub: the pairs of blocks that may hold a pair at the threshold.

    By the triangle inequality two vectors are at least angle(pivots) - radius - radius apart, so blocks for which that is
    more than the threshold's angle are left out.  Radii are of a block on the seeds' side and of a cell on the targets'."""
    most = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6  # an angle is exact to about 1e-8 near 0
    apart = np.arccos(np.clip(np.einsum("sd,td->st", pivots, pivots), -1, 1)).ravel().tolist()
    n = len(pivots)
    s = seeds.groupBy(F.col("cell").alias("s_cell"), F.col("sub").alias("s_sub")).agg(F.max("angle").alias("s_radius"))
    t = targets.groupBy(F.col("cell").alias("t_cell"), F.col("sub").alias("t_sub")).agg(F.max("angle").alias("t_radius"))
    cells = t.groupBy(F.col("t_cell").alias("__cell")).agg(F.max("t_radius").alias("__radius"))
    angles = F.array(*[F.lit(x) for x in apart])
    may = s.withColumn("__cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(cells, "__cell")  # at most MOST_CELLS a block
    may = may.where(angles[F.col("s_cell") * n + F.col("__cell")] - F.col("s_radius") - F.col("__radius") <= most)
    return may.join(t, F.col("__cell") == F.col("t_cell")).select("s_cell", "s_sub", "t_cell", "t_sub")


#: Cells of the targets at most, and so pivots that go to the executors.
MOST_CELLS = 64


def cosine_join(
    seeds: DataFrame, targets: DataFrame, threshold: float = -1.0, maximum: float | None = None, per_query: int | None = None, seed_block: int = 2048, target_block: int = 4096, cells: int | None = None
) -> DataFrame:
    """query_id, target_id, similarity: pairs of each seed with all targets that reach the threshold; with ``per_query``
    the best of each seed (ties: the smallest target_id).  Any number of seeds.

    The targets are dealt into cells around some of them (pivots, chosen by a hash), cells into blocks; so are the seeds.
    Pairs of blocks that cannot reach the threshold are left out (``block_pairs``); a task multiplies one block of seeds by
    one of targets and keeps each seed's best.  So a task holds two blocks and the hits of their pairs, whatever the sizes.
    Small tables, and searches that can leave nothing out, are one cell.  seeds: query_id, vec.  targets: target_id, vec.
    Rows without an id or a vector are left out.
    """
    kinds = [T.StructField("query_id", seeds.schema["query_id"].dataType), T.StructField("target_id", targets.schema["target_id"].dataType)]
    out = T.StructType([*kinds]).add("similarity", "double")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds] + [("similarity", pa.float64())])
    n_seeds, n_targets = seeds.count(), targets.count()
    if cells is None:  # each cell of seeds is a block at least
        cells = 1 if threshold <= -1 else max(1, min(MOST_CELLS, n_targets // (4 * target_block), n_seeds // seed_block))
    key = ["s_cell", "s_sub", "t_cell", "t_sub"]
    if cells == 1:
        left, right = _grid(seeds, "query_id", targets, "target_id", -(-n_seeds // seed_block) or 1, -(-n_targets // target_block) or 1)
    else:
        first = targets.where("vec is not null").orderBy(F.xxhash64("target_id"), "target_id").limit(cells).select("vec").collect()
        if not first:
            return targets.sparkSession.createDataFrame([], out)
        pivots = _units(np.array([r.vec for r in first], np.float64))
        s, t = _cells(seeds, "query_id", pivots, seed_block), _cells(targets, "target_id", pivots, target_block)
        pairs = materialize(block_pairs(s, t, pivots, threshold), "pairs")
        left = s.withColumnsRenamed({"cell": "s_cell", "sub": "s_sub"}).join(pairs, key[:2]).select(*key, "id", "vec")
        right = t.withColumnsRenamed({"cell": "t_cell", "sub": "t_sub"}).join(pairs, key[2:]).select(*key, "id", "vec")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        right = right.take(pc.sort_indices(right.column("id")))  # a row's place is its rank by id
        mine, theirs, value = _near(*(_units(_matrix(side.column("vec"))) for side in (left, right)), threshold, maximum, per_query)
        return pa.table([left.column("id").take(pa.array(mine)), right.column("id").take(pa.array(theirs)), pa.array(value)], schema=arrow)

    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(score, out)
    return top_k(hits, "similarity", per_query)


def top_k(hits: DataFrame, score: str, k: int | None, per: list[str] = ("query_id",)) -> DataFrame:
    """The k best hits of each group: score down, then query_id, then target_id."""
    return top_n(hits, list(per), order(f"-{score}", "query_id", "target_id"), k)


def search(seeds: DataFrame, targets: DataFrame, metric: str, threshold: float, maximum: float | None = None, per_query: int | None = None, top: int | None = None) -> DataFrame:
    """query_id, target_id, score of either metric, with the same limits: the band, then the best ``per_query`` of each
    seed, then the best ``top`` of all.  Packed sides have words and bitcount, dense ones vec; other metrics and sides that
    do not suit raise ValueError."""
    packed_side = lambda df: "words" in df.columns
    check_metric(metric, {"packed": packed_side(seeds)}, {"packed": packed_side(targets)})
    if metric == "tanimoto":
        hits = tanimoto_join(seeds, targets, threshold, maximum, _least(per_query, top)).withColumnRenamed("tanimoto", "score")
    else:
        hits = cosine_join(seeds, targets, threshold, maximum, per_query).withColumnRenamed("similarity", "score")
    return hits if top is None else hits.orderBy(*order("-score", "query_id", "target_id")).limit(top)


def _least(*limits: int | None) -> int | None:
    """The smallest limit; None is none."""
    return min((n for n in limits if n is not None), default=None)


def similarity_search(
    proteins: DataFrame, targets: DataFrame, threshold: float, maximum: float | None = None, per_query: int | None = None, top: int | None = 10_000
) -> DataFrame:
    """uniprot_id, target_id, query_id, tanimoto: for every protein the targets like one of its seeds.

    proteins: uniprot_id, query_id, words, bitcount (its seeds); each distinct seed is scored once, however
    many proteins share it, and proteins of the same seeds are ranked once.  ``maximum`` applies before any limit.  ``top``
    limits a protein's (seed, target) hits, after which a target keeps its best hit, so fewer than ``top`` targets may stay.

    A hit that ``top`` others of its own seed precede is beyond ``top`` for any protein, so each seed's first ``top`` do.
    """
    proteins = materialize(proteins.select("uniprot_id", "query_id", "words", "bitcount"), "seeds")
    seeds = proteins.select("query_id", "words", "bitcount").dropDuplicates(["query_id"])
    hits = tanimoto_join(seeds, targets, threshold, maximum, _least(per_query, top))
    own = proteins.where("query_id is not null").groupBy("uniprot_id").agg(F.sort_array(F.collect_set("query_id")).alias("seeds"))
    sets = own.groupBy("seeds").agg(F.min("uniprot_id").alias("first"))
    mine = sets.select(F.col("first"), F.explode("seeds").alias("query_id")).join(hits, "query_id")
    mine = top_k(mine, "tanimoto", top, ["first"])
    mine = materialize(keep_first(mine, ["first", "target_id"], order("-tanimoto", "query_id")), "of-seed-sets")
    of = own.join(sets, "seeds").select("uniprot_id", F.col("first").alias("__first"))
    return of.join(mine, F.col("first").eqNullSafe(F.col("__first"))).select("uniprot_id", "target_id", "query_id", "tanimoto")


def max_pairwise(rows: DataFrame, group: str) -> DataFrame:
    """The highest Tanimoto of two rows of a group with different ids: group, max_tanimoto; 0 if none share a bit.  Groups of
    any size: each row brings its best partner."""
    some = rows.where(F.col(group).isNotNull() & F.col("id").isNotNull()).select(group, "id", "words", "bitcount")
    side = some.withColumn("__own", F.xxhash64("id"))
    any_bit = 1e-9  # below 1 over the number of bits
    found = tanimoto_join(side.withColumn("query_id", F.struct(group, "id")), side.withColumnRenamed("id", "target_id"), any_bit, per_query=1, within=[group], other_ids=True)
    best = found.groupBy(F.col("query_id")[group].alias("__group")).agg(F.max("tanimoto").alias("best"))
    groups = some.groupBy(group).agg(F.min("id").alias("__low"), F.max("id").alias("__high")).where("__low < __high")
    return groups.join(best, F.col(group) == F.col("__group"), "left").select(group, F.coalesce("best", F.lit(0.0)).alias("max_tanimoto"))


def need(threshold: float, bits: int) -> tuple[int, int]:
    """The bit counts a partner may have (driver side, for tests and planning)."""
    return max(0, math.floor(bits * threshold) - 1), math.ceil(bits / threshold) + 1
