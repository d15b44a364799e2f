"""Connected components of a graph of long ids, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is two shuffles of the edges; the number of steps grows with the logarithm of the nodes. Nothing goes to the driver
but a count and a checksum of each step, and each step is a table in the shared folder, so lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _large(e: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node's larger neighbours go to the least of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))  # as a table, so that AQE can split the edges of a large star
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the least of them. Edges are a < b."""
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), "b")
    rest = e.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return own.unionByName(rest).distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node of each node's component, for nodes that have an edge and aren't the root."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    path, before = None, None
    while True:
        new = scratch.write(_small(_large(e, scratch)))
        e = scratch.spark.read.schema("a long, b long").parquet(new)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if path:
            scratch.drop(path)
        path = new
        if now == before or not now[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
