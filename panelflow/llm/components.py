"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps on a table of edges in the
cluster: each round replaces edges by edges to smaller neighbours until
the graph is a set of stars.  The least neighbour of each node is a
map-side combined aggregate, and it is joined back to the node's edges in
several parts if they are many (every round ends in stars, so the root of a
large component is such a hub); no edge, node or component is gathered
anywhere.  Each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.session import cut_lineage

from .common import hub_limit, spread_join

MAX_ROUNDS = 60     # stars need O(log^2 n) rounds; reaching this raises


def _star(edges: DataFrame, large: bool, limit: int) -> DataFrame:
    """One star step on edges (u, v), u > v; nodes with over ``limit`` edges are hubs.

    Large: each node links its larger neighbours to its least neighbour.
    Small: each node links its smaller neighbours and itself to the least."""
    if large:
        arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select("u", "v")
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    linked = spread_join(arcs, least, "u", "v", limit)
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node
    of its component.  ``edges`` has two columns a, b of one orderable type."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, limit = None, hub_limit(2 * e.count())
    for _ in range(MAX_ROUNDS):
        e = cut_lineage(_star(_star(e, True, limit), False, limit))
        # the edge set as (count, order-free sum of hashes): equal twice means it is stable
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # stable stars: every edge leads from a node to its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
