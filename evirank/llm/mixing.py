"""Source mixing: Sainte-Lague apportionment of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A source has at most so many shards, so the quota table is bounded by the number of sources.
MAX_SHARDS = 4096


def sainte_lague(weights: list[int], seats: int, caps: list[int]) -> list[int]:
    """Integer seats by the highest quotients weight / (2k + 1), no party above its cap; ties go to the
    earlier party.  A divisor search settles all but a few seats at once, a heap hands out the rest, so
    the cost does not depend on the number of seats.  Seats that no party may take stay free."""
    seats = min(seats, sum(caps))
    n = len(weights)
    if seats <= 0 or not any(weights):
        return [0] * n
    fill = lambda d: [min(c, (w + d) // (2 * d)) if w else 0 for w, c in zip(weights, caps, strict=True)]
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w))
    # round(w / (2d)) with an integer d: scaling makes d fine enough for any seat count
    scale = 4 * (seats + 1) * n
    weights = [w * scale for w in weights]
    low, high = 1, max(weights) + 1
    while low < high:  # the smallest divisor that hands out at most `seats`
        mid = (low + high) // 2
        low, high = (low, mid) if sum(fill(mid)) <= seats else (mid + 1, high)
    got = fill(low)
    heap = [(Fraction(-w, 2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, got, caps, strict=True)) if w and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (Fraction(-weights[i], 2 * got[i] + 1), i))
    return got


def targets_of(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """Shares of all sizes by weight; a target stops at ``max_repeats`` times its source's size and the
    excess is shared again by weight until none is above."""
    total, caps = float(sum(sizes)), [max_repeats * float(s) for s in sizes]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > caps[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in over:
            out[i] = caps[i]
        free -= set(over)
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_repeats: int = 3,
    shard_tokens: int = 1_000_000,
    seed: int = 17,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, shard, shard_quota (blocks), block_tokens, taken.

    Sources in code-point order, null last, get the weights in turn.  The mix has as many tokens as the
    corpus, cut into equal blocks of ``block_tokens`` (a thousandth of the smallest positive target, 1 to
    1024, so that rounding is below 0.1 % of any target).  Sainte-Lague hands the blocks to sources by
    their targets and each source's blocks to its shards by their sizes, never above ``max_repeats``
    times a shard.  Inside a shard the documents stand in a seeded order on a ring; the quota's blocks
    are taken from a seeded start round the ring, so a document is taken whole times and at most once in
    part.  ``taken`` never exceeds ``max_repeats`` times the size.

    One row per input row.  Null or empty texts have size 0 and take 0; a null source is a source of its
    own; repeated rows count each; an empty table gives an empty result.  Other columns are ignored.
    The driver gets one row per source (at most ``max_sources``, else ValueError) and per shard.
    """
    spark = docs.sparkSession
    h = F.xxhash64("doc_id", F.lit(seed))
    sized = materialize(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h")
        ),
        "sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(per_source) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    per_source.sort(key=lambda r: (r.source is None, r.source or ""))
    names, sizes = [r.source for r in per_source], [r.n for r in per_source]
    target = targets_of(sizes, [weights[i % len(weights)] for i in range(len(names))], max_repeats)
    block = int(min(1024, max(1, min([t for t in target if t > 0], default=1) // 1000)))
    shards = [max(1, min(MAX_SHARDS, -(-n // shard_tokens))) for n in sizes]
    plan = spark.createDataFrame(
        list(zip(names, sizes, target, shards, strict=True)),
        "src string, source_size long, target double, n_shards long",
    )
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn(
        "shard", F.floor(F.pmod("h", F.lit(MAX_SHARDS)) * F.col("n_shards") / F.lit(MAX_SHARDS)).cast("long")
    )
    at = {s: i for i, s in enumerate(names)}
    by: list[list[tuple[int, int]]] = [[] for _ in names]
    for r in placed.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect():
        by[at[r.source]].append((r.shard, r.n))
    caps = [sum(max_repeats * n // block for _, n in x) for x in by]
    blocks = sainte_lague([round(t * 1024) for t in target], round(sum(sizes) / block), caps)
    quotas = []
    for name, x, q in zip(names, by, blocks, strict=True):
        x.sort()
        got = sainte_lague([n for _, n in x], q, [max_repeats * n // block for _, n in x])
        quotas += [(name, k, n, g) for (k, n), g in zip(x, got, strict=True)]
    quota = spark.createDataFrame(
        quotas, "q_src string, q_shard long, shard_size long, shard_quota long"
    )
    c = F.col
    ring = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.join(quota, c("source").eqNullSafe(c("q_src")) & (c("shard") == c("q_shard"))).withColumn("hi", F.sum("size").over(ring))
    n, lo, hi = c("shard_size"), c("hi") - c("size"), c("hi")
    whole = F.expr(f"shard_quota * {block} div greatest(shard_size, 1L)")
    part = F.col("shard_quota") * block - whole * n
    start = F.expr(f"pmod(xxhash64(source, shard, {seed}), greatest(shard_size, 1L)) div {block} * {block}")
    once = lambda a, b: F.greatest(F.lit(0), F.least(hi, b) - F.greatest(lo, a))
    taken = whole * c("size") + once(start, start + part) + once(F.lit(0), start + part - n)
    return laid.select(
        "doc_id", "source", "size", "source_size", "target", "shard", "shard_quota", F.lit(block).alias("block_tokens"),
        taken.cast("long").alias("taken"),
    )
