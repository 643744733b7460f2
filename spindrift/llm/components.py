"""Connected components of an edge table by alternating large-star and small-star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stash

EDGES_PER_FILE = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
    rest = edges.join(least, F.col("u") == F.col("c")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select(F.col("c").alias("u"), F.col("m").alias("v")).unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """Columns id and component (the smallest id reachable), for every id of `edges` (u, v) but the components' smallest.

    Loops and repeated edges are allowed. The steps needed grow with the logarithm of the longest path.
    """
    current = stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state, width = None, shuffle_width(edges.sparkSession)
    while True:
        # A sum of hashes tells whether anything changed.
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
        # A few edges need no more files than tasks to write them.
        files = min(width, 8 + now[0] // EDGES_PER_FILE)
        current = stash(_small_star(stash(_large_star(current).distinct().coalesce(files))).distinct().coalesce(files))
