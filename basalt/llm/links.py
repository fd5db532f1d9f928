"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; component: the smallest node reachable.

    Each round every node takes the smallest component among its neighbours (an aggregation with
    map-side combining) and then the component of its component, so a path of n links takes about
    log n rounds.  Rounds are written to the shared folder.  A node with very many links is only a
    frequent join key, which adaptive execution splits; no neighbour lists are gathered."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = shared.cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    state = shared.cut(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "components")
    before = None
    while True:
        total = state.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).collect()[0]["s"]
        if total == before or total is None:
            break
        before = total
        seen = edges.join(state.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("m"))
        lower = shared.cut(state.join(seen.withColumnRenamed("x", "node"), "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component")), "components")
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("top"))
        nxt = shared.cut(lower.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "components")
        shared.drop_cut(state, lower)
        state = nxt
    shared.drop_cut(edges)
    return state
