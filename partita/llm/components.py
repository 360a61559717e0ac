"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.llm.common import written


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); the component is its smallest node.

    Large stars link a node's larger neighbours to its least neighbour, small stars link the smaller ones; both keep the
    components, and in logarithmically many rounds only stars around the least nodes are left. Neighbourhoods are only
    reduced to their minimum, never collected, so a node of any degree is safe. Every round is written to the shared folder.
    An empty table gives no rows; loops and repeated edges change nothing.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = None
    for _ in range(most):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = written(stars.distinct(), "stars")
        total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))  # noqa: E731 - nodes may be any longs
        now = edges.agg(F.count("*"), total("a"), total("b"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
