"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import Workspace


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the component's smallest node.

    Each step links a node's neighbours to the smallest of them. Edges only ever go to a smaller
    node and their number never grows, so a hub with very many neighbours costs one row each; the
    minimum per node is an aggregate with map-side combining, and the join back to it is one that
    adaptive execution splits where a node is hot.
    """
    now = ws.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0"
    )
    before, i = _signature(now), 0
    while before[0]:
        # large star: each node links its larger neighbours to the smallest of itself and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(F.col("a").alias("u"), "m")
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        after = ws.save(small.filter("a <> b").distinct(), f"{name}-{i + 1}")
        ws.drop(f"{name}-{i}")
        now, i, was = after, i + 1, before
        before = _signature(now)
        if before == was:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
