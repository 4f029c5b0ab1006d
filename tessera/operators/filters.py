"""Filters: each is a DataFrame of distinct subjects ``s``, full-text and vector filters with a ``score``."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..plans.graph import Graph
from ..plans.materialize import materialized
from ..plans.spec import Filter
from . import fts, vectors

#: What java.util.regex has beyond linear-time engines: look-around and back-references.
_NOT_LINEAR = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


#: Frontiers of at most so many subjects are broadcast.
FRONTIER = 50_000


def climb(graph: Graph, subjects: DataFrame, hops: int) -> DataFrame:
    """The subjects exactly ``hops`` steps above, under any predicate.

    Every step's frontier is made distinct and written before the next; a small one is broadcast, so that the quads aren't shuffled.
    """
    score = [c for c in subjects.columns if c == "score"]
    for _ in range(hops):
        up = graph.quads().select(F.col("s").alias("_up"), F.col("o").alias("s"))
        subjects = materialized(subjects, "frontier")
        small = subjects.limit(FRONTIER + 1).count() <= FRONTIER
        subjects = up.join(F.broadcast(subjects) if small else subjects, "s").select(F.col("_up").alias("s"), *score)
        subjects = subjects.groupBy("s").agg(F.max("score").alias("score")) if score else subjects.distinct()
    return subjects


def full_match(pattern: str) -> str:
    """A pattern that Spark's ``rlike`` matches against whole strings; the dot leaves out newlines only."""
    if _NOT_LINEAR.search(pattern):
        raise ValueError("look-around, back-references and possessive quantifiers aren't supported")
    return rf"(?d)^(?:{pattern})\z"


def _literal_subjects(graph: Graph, found: DataFrame, f: Filter) -> DataFrame:
    """Subjects of the literals ``found(key[, score])``."""
    q = graph.quads()
    if f.prop:
        q = q.where(F.col("p") == graph.key(f.prop))
    if f.graphs:
        q = q.where(graph.isin("g", f.graphs))
    j = q.select("s", F.col("o").alias("key")).join(found, "key")
    return j.groupBy("s").agg(F.max("score").alias("score")) if "score" in found.columns else j.select("s").distinct()


def subjects(graph: Graph, f: Filter, config: EngineConfig, query_vector: list[float] | None = None, index: fts.Index | None = None) -> DataFrame:
    """Evaluate one filter."""
    q = graph.quads()
    if f.graphs:
        q = q.where(graph.isin("g", f.graphs))
    if f.kind == "random":
        return materialized(q.select("s").orderBy(F.rand()).limit(f.count), "sample").distinct()
    if f.kind == "id":
        return q.where(graph.isin("s", f.objects)).select("s").distinct()
    if f.kind == "object":
        return climb(graph, q.where(graph.isin("o", f.objects)).select("s").distinct(), f.hops)
    if f.kind in ("pair", "predicate"):
        q = q.where(F.col("p") == graph.key(f.predicate))
        if f.kind == "pair":
            q = q.where(graph.isin("o", f.objects))
        return climb(graph, q.select("s").distinct(), f.hops)
    if f.kind in ("regex", "fts") and graph.inline and index is None:
        texts = graph.quads().where(F.col("o").startswith('"'))
        mine = q.where(F.col("o").startswith('"'))
        if f.prop:
            mine = mine.where(F.col("p") == graph.key(f.prop))
        if f.kind == "regex":
            return climb(graph, mine.where(F.col("o").rlike(full_match(f.text))).select("s").distinct(), f.hops)
        return climb(graph, fts.search_in_place(texts.select(F.col("o").alias("value")), mine.select("s", F.col("o").alias("value")), f.text, config.fts), f.hops)
    if f.kind == "regex":
        hit = graph.literals(f.prop).where(F.col("value").rlike(full_match(f.text))).select("key")
        return climb(graph, _literal_subjects(graph, hit, f), f.hops)
    if f.kind == "fts":
        hit = index.search(f.text) if index is not None else fts.search(graph.literals(), f.text, config.fts)
        return climb(graph, _literal_subjects(graph, hit, f), f.hops)
    if f.kind == "semantic":
        if graph.vectors() is None or query_vector is None:
            raise ValueError("the graph has no vectors")
        near = vectors.nearest(graph.vectors(), query_vector, config.semantic_distance)
        return near.groupBy("s").agg(F.max("score").alias("score"))
    raise ValueError(f"unknown filter {f.kind!r}")


def combine(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Boolean algebra over subject sets: *and* binds to the last *or* term; every *not* is taken from the whole; the first op doesn't matter."""
    terms: list[DataFrame] = []
    nots: list[DataFrame] = []
    for i, (op, df) in enumerate(parts):
        df = df.select("s")
        if i and op == "not":
            nots.append(df)
        elif i and op == "and":
            terms[-1] = terms[-1].join(df, "s", "left_semi")
        else:
            terms.append(df)
    out = terms[0]
    for t in terms[1:]:
        out = out.union(t)
    out = out.distinct()
    for n in nots:
        out = out.join(n, "s", "left_anti")
    return out
