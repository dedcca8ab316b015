"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import apart, cut


#: Edges that one task holds, about: a round's table has as many parts as its predecessor's edges fill.
PART = 500_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs to (node, root): root is the smallest node of the component.

    Alternates large-star and small-star steps, whose aggregates are plain minima, so that a hub is
    pre-aggregated on the map side and its rows are dealt out by skew joins; the edge list never grows
    beyond twice its size and a round's state is a table in the shared folder. Loops, repeated and
    reversed edges are harmless; nodes without an edge to another node don't appear. No edges: no rows.
    """
    stars = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, before = cut(stars), None
    for _ in range(max_rounds):
        row = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(row) or not row[0]:
            break
        before = tuple(row)
        state = cut(_small_star(_large_star(state)).coalesce(1 + 2 * row[0] // PART))
    else:
        raise RuntimeError("connected components did not settle")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = apart(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "a")
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = apart(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    hooked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
