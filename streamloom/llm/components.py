"""Connected components of an edge table by alternating star contractions; labels are the smallest node reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: Edges up to which a round broadcasts the nodes' least neighbours (two rows of 16 bytes an edge at most) and runs in a task for
#: PART_EDGES of them, at least LEAST_PARTS: the driver keeps something of every task, so that many small ones cost it memory.
BROADCAST_EDGES, PART_EDGES, LEAST_PARTS = 100_000, 5_000, 8


def _with_least(edges: DataFrame, parts: int | None) -> DataFrame:
    """Edges (u, v) with the least of u's neighbours and u itself as m. A hub's edges meet its one row in a join, which splits skew or moves none of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least.coalesce(parts).hint("broadcast") if parts else least.hint("merge"), "u")


def _state(edges: DataFrame, parts: int | None) -> tuple[int, bool]:
    """The number of distinct edges, and whether they are stars: every greater end has one edge only and is no lesser end."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    each = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    n, open_ = (each.coalesce(parts) if parts else each).agg(F.sum("ups"), F.count_if(F.expr("ups > 0 and n > 1"))).first()
    return n or 0, not open_


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the least node that it reaches.

    Large-star and small-star rounds run as joins until only stars are left, which may be at once; each round is written to the
    shared folder. Nodes without an edge to another node have no row. Null ends and loops are left out; repeated edges change nothing.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    parts = None
    for _ in range(max_rounds):
        n, stars = _state(now, parts)
        if stars:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        parts = max(LEAST_PARTS, n // PART_EDGES) if n <= BROADCAST_EDGES else None
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, parts).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        if not parts:
            large = large.distinct()
        # small star: all of u's lesser neighbours and u go to the least of them
        met = _with_least(large, parts)
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        now = materialise(small.coalesce(parts) if parts else small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
