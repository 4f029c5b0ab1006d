"""Aggregates over graphs and match sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph


def total(graph: Graph) -> DataFrame:
    """``total``: distinct subjects."""
    return graph.repeated().agg(F.count_distinct(*graph.identity("s")).alias("total"))


def properties(graph: Graph) -> DataFrame:
    """``value, count``: distinct subjects a predicate."""
    counted = graph.repeated().groupBy(F.col("p").alias("value")).agg(F.count_distinct(*graph.identity("s")).alias("count"))
    return graph.decoded(counted, ["value"], iris=["value"])


def count_by_property(graph: Graph, predicate: str) -> DataFrame:
    """``value, count``: distinct subjects an object that is no literal."""
    q = graph.quads().where(F.col("p") == graph.key(predicate))
    counted = q.groupBy(F.col("o").alias("value")).agg(F.count_distinct("s").alias("count"))
    return graph.decoded(graph.is_iri(counted, "value"), ["value"], iris=["value"])


def facet(graph: Graph, name: str, matched: DataFrame | None = None) -> DataFrame:
    """``count, value``: triples a predicate (``properties``), a named graph (``graphs``) or an object of a predicate.

    ``matched(s)`` restricts to its subjects.  The partial counts are taken before anything is shuffled by value.
    """
    q = graph.quads()
    column = {"properties": "p", "graphs": "g"}.get(name, "o")
    if column == "g":
        q = q.where(F.col("g") != graph.key(""))
    elif column == "o":
        q = q.where(F.col("p") == graph.key(name))
    if matched is not None:
        q = q.join(matched.select("s"), "s", "left_semi")
    counted = graph.decoded(q.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count")), ["value"], iris=[] if column == "o" else ["value"])
    return counted.where(F.col("value").isNotNull()).select("count", "value")


def similar(graph: Graph, seed: str, more_than: int = 10, predicates: list[str] | None = None) -> DataFrame:
    """``s, shared``: subjects that share more than so many (predicate, object) pairs with the seed, itself included."""
    q = graph.quads()
    if predicates:
        q = q.where(graph.isin("p", predicates))
    own = q.where(F.col("s") == graph.key(seed)).select("p", "o")
    return q.join(own, ["p", "o"]).groupBy("s").agg(F.count("*").alias("shared")).where(F.col("shared") > more_than)
