"""Connected components of links between documents, by alternating large and small stars over DataFrames.

A node's least neighbour is found with partial aggregation. The join that hands it out is on the node, so a hub's links meet
in one partition, rows of two numbers; Spark's handling of skewed joins splits it where it grows large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


#: Links in a scratch file, about; each file costs its writer more than this many rows do.
FILE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) to (a, b) with b the smallest node that a reaches; nodes that are smallest have no row."""
    edges, path = common.written(edges.where("a <> b").distinct(), "links")
    files = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // FILE))
    state = None
    while True:
        before = path
        edges, path = common.written(_small(_large(edges)).coalesce(files), "stars")
        common.removed(edges.sparkSession, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now
