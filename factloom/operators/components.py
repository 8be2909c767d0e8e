"""Connected components of an edge table, distributed, in a number of rounds that is logarithmic in practice.

Alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce and beyond"): every
round rewires edges towards the smallest node seen, and the edge set becomes a forest of stars whose centres are the
smallest nodes.  A round is two aggregations and two equi-joins; nothing is collected but one fingerprint of the edge
set, and each round's edges are a table in the shared folder (the last round's is deleted), so lineage stays short and
executors may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import forget, shared_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        near = down.join(low, "a")
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with an edge to another node; component is the smallest node of the component.

    Direction, repeated edges, self-loops and edges with a null end make no difference (the latter two are dropped).
    Ends when a round changes nothing, however many it takes.
    """
    now = shared_table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        before, now = now, shared_table(_star(_star(now, True), False), "stars")
        forget(before)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            centres = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.select("node", F.col("node").alias("component")))
        mark = seen
