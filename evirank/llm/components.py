"""Connected components over an edge table by alternating min-neighbour stars with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: A node with more rows than this is met by a broadcast.
HUB = 1_000_000


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v) with the m of their u.  Hubs, nodes of so many rows that there are at most 200,000 of them,
    are broadcast to their rows, which stay where they are; the others meet in a shuffle."""
    most = max(HUB, n // 200_000)
    if n <= most:
        return rows.join(least, rows.u == least.k)
    hubs = F.broadcast(least.where(F.col("rows") > most))
    rest = rows.join(hubs.select("k"), rows.u == F.col("k"), "left_anti")
    return rows.join(hubs, rows.u == F.col("k")).union(rest.join(least, rest.u == least.k))


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then each v is the root of its component."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) links, in either direction and possibly repeated, to (node, root): root is the smallest
    node reachable.  Only nodes that have a link appear; empty edges give an empty table.

    Each round is one large-star and one small-star step (Kiveris et al., 2014): every node hooks its
    neighbours onto the smallest one, so path lengths fall geometrically and the edge count never grows.
    The group of a hub is only ever reduced with min(), never gathered.  Rounds end when the edges are
    stars; each is written to the shared folder, so lineage stays short.  Edges that are stars already
    cost no round.
    """
    e = materialize(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    rounds = 0
    while not _is_forest_of_stars(e):
        if rounds == max_rounds:
            raise RuntimeError("components did not converge")
        rounds += 1
        n = e.count()
        # large star: each node's strictly larger neighbours, joined to its smallest neighbour or itself
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "rows")
        large = _with_least(both, least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself, joined to the smallest of them
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select(F.col("u").alias("k"), "m", "rows")
        small = (
            _with_least(large, least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, "small-star")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
