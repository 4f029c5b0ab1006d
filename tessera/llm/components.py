"""Connected components of an edge table by alternating large and small stars.

Each half step is an aggregation with map-side combine and a join on the node, so a node in a
third of all edges is no task's burden alone.  Edges are written to the shared folder every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        e = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = e.join(least, "a")
    out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``edges(a, b)`` but each component's smallest node."""
    e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
        e = table(_star(_star(e, True), False), "edges")
