"""Fetching entities, rows and hierarchy paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.materialize import materialized
from ..plans.spec import QuerySpec


def entity_rows(graph: Graph, subjects: DataFrame, spec: QuerySpec) -> DataFrame:
    """Distinct ``s, p, o, g`` of the subjects, by the projection of the request; the subjects' other columns stay."""
    q = graph.by_subject()
    if spec.only_properties:
        q = q.where(graph.isin("p", spec.only_properties))
    elif spec.exclude_properties:
        q = q.where(~graph.isin("p", spec.exclude_properties))
    return q.join(subjects, "s").distinct()


def spo(graph: Graph, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Decoded ``s, p, o`` of matching quads, duplicates and all; None or empty matches everything."""
    q = graph.by_subject() if s else graph.quads()
    for column, term in zip("spog", (s, p, o, g)):
        if term is not None and not isinstance(term, str):
            raise TypeError(f"{column} must be a string")
        if term:
            q = q.where(F.col(column) == graph.key(term))
    return q.select("s", "p", "o")


def sp(graph: Graph, subjects: list[str], p: str | None = None) -> DataFrame:
    """``s, o`` of the listed subjects, duplicates kept."""
    if not isinstance(subjects, (list, tuple)):
        raise TypeError("subjects must be a list")
    q = graph.by_subject()
    q = q.where(graph.isin("s", subjects)) if subjects else q.where(F.lit(False))
    if p:
        q = q.where(F.col("p") == graph.key(p))
    return q.select("s", "o")


def paths(graph: Graph, subjects: DataFrame, predicate: str) -> DataFrame:
    """``s, path``: ancestors of each subject under ``predicate``, nearest first, up to a root.

    Climbs from the wanted subjects only, one frontier a step; a path that meets itself ends there without
    a result, and of several paths the shortest, then smallest, stands.  A parent that isn't a subject
    itself is no root.
    """
    edges = graph.quads().where(F.col("p") == graph.key(predicate)).select(F.col("s").alias("_c"), F.col("o").alias("_parent")).distinct()
    nodes = graph.quads().select(F.col("s").alias("_parent")).distinct()
    edges = materialized(edges.join(nodes, "_parent", "left_semi"), "edges")
    has_parent = graph.quads().where(F.col("p") == graph.key(predicate)).select(F.col("s").alias("_at")).distinct()
    kind = graph.quads().schema["s"].dataType
    live = subjects.select("s", F.col("s").alias("_at"), F.array().cast(f"array<{kind.simpleString()}>").alias("path"))
    climbed = live
    while True:  # ends: no path holds a node twice
        live = materialized(live.join(edges, live["_at"] == edges["_c"]).where((F.col("_parent") != F.col("s")) & ~F.array_contains("path", F.col("_parent"))).select("s", F.col("_parent").alias("_at"), F.array_append("path", F.col("_parent")).alias("path")), "frontier")
        if live.isEmpty():
            break
        climbed = climbed.union(live)
    done = climbed.join(has_parent, "_at", "left_anti")
    return done.groupBy("s").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b")).select("s", F.col("b.path").alias("path"))
