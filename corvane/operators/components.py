"""Connected components by alternating large-star and small-star passes over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.sources.storage import forget, settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id in ``edges`` (columns ``a, b``): the smallest id reachable.

    Each pass keeps one edge per node and neighbour at most, and joins a node's edges with its minimum only, so a
    hub costs its degree. Every pass is written to the shared folder; nothing but a count and a checksum reaches
    the driver. Edges with a null end or from a node to itself are ignored.
    """
    cur = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(roots.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = settle(small, "edges")
        forget(cur)
        cur, seen = small, _mark(small)
        if seen == mark:
            break
        mark = seen
    own = cur.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return own.unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
