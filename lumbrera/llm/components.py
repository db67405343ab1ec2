"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins over narrow rows; a hub with very many neighbours meets a single row on
the other side, which Spark splits when it is skewed. The number of rounds is logarithmic in the
length of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbrera.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    around = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return around.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Every node points at one root, and no root points on: the components are found."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return seen.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the root is the least node of its component."""
    now = written(_small_star(edges.where(F.col("a") != F.col("b")).select("a", "b")), "edges")
    while not _only_stars(now):
        now = written(_small_star(_large_star(now)), "edges")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
