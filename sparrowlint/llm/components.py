"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlint.runtime import Workspace


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the component's least node.

    Both steps are a minimum with map-side combining and an equi-join on the node, whose
    hot nodes AQE splits; a round's edges are written to the shared folder, so lineage
    stays short. Self-loops and repeated edges are harmless; no edges give no rows. The
    number of rounds follows the logarithm of the longest path.
    """
    now = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    now = ws.table(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    state, k = _state(now), 0
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        now = ws.table(small, f"cc{k}")
        ws.drop(f"cc{k - 1}")
        if (after := _state(now)) == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
