"""Connected components of an undirected graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandforge.session import materialised


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node of the node's component. Nodes without an edge to another have no row.

    Each round links every node's larger neighbours to its smallest (large star), then its smaller ones (small star), and
    ends when a round changes nothing; rounds grow as the square of the logarithm of the nodes at most. Every round is written to the shared
    folder, nothing is collected. Node values are BIGINT; edges with a null or to the node itself are left out.
    """
    e = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    e = materialised(e, "edges")
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        small = linked.filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialised(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
