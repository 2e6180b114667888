"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step is a group-by and a join, and nothing is gathered on the driver but one count and one checksum a round.  The
least neighbour of each node is a written table, so that a join with it shuffles both of its sides itself: then the engine
can split a node with very many neighbours over tasks, which it can't where the group-by's own shuffle is used again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.scratch import Scratch

MAX_ROUNDS = 40


def _star(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _joined(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("u", "v", "m")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) of non-null ids -> table (node, component) of the nodes that aren't the least of their component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, known = scratch.table(edges, f"{name}-0"), None
    for i in range(1, MAX_ROUNDS):
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        known = (n, mark)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(_star(both).withColumn("m", F.least("u", "m")), f"{name}-{i}-least")
        large = _joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}-{i}-large")
        small = _joined(large, scratch.table(_star(large), f"{name}-{i}-small"))
        flat = small.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        edges = scratch.table(flat, f"{name}-{i}")
        for done in (f"{name}-{i - 1}", f"{name}-{i}-least", f"{name}-{i}-large", f"{name}-{i}-small"):
            scratch.drop(done)
    raise RuntimeError("links don't settle")
