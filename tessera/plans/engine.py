"""The query engine: requests to lazy plans, plans to answers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import facets, filters, fts, order, pages, vectors
from .graph import Graph
from .spec import QuerySpec, parse


@dataclass
class Plan:
    """One request over one graph; every property is a DataFrame of keys."""

    graph: Graph
    spec: QuerySpec
    config: EngineConfig
    query_vectors: dict[str, list[float]]
    index: fts.Index | None = None

    @cached_property
    def matched(self) -> DataFrame:
        """The match set: ``s``, and ``score`` if a filter scores."""
        if not self.spec.filters:
            return self.graph.quads().select("s").distinct()
        parts, scores = [], []
        for f in self.spec.filters:
            df = filters.subjects(self.graph, f, self.config, self.query_vectors.get(f.text), self.index)
            parts.append((f.op, df))
            if "score" in df.columns:
                scores.append(df)
        out = filters.combine(parts)
        if scores:
            every = scores[0]
            for s in scores[1:]:
                every = every.union(s)
            out = out.join(every.groupBy("s").agg(F.max("score").alias("score")), "s", "left")
        return out

    def ranked(self) -> DataFrame:
        """The page: ``s, pos`` (from 1, in order) and the label or score it is ordered by."""
        df, keys = order.ordered(self.graph, self.matched, self.spec.order, self.config)
        page = df.orderBy(*keys).offset(self.spec.start).limit(self.spec.size)
        # positions over the page only: at most `size` rows
        return page.withColumn("pos", F.row_number().over(W.orderBy(*keys)) + self.spec.start)

    def facet(self, name: str) -> DataFrame | None:
        if not self.spec.filters:
            return facets.facet(self.graph, name) if name in ("properties", "graphs") else None
        return facets.facet(self.graph, name, self.matched)

    def entities(self, page: DataFrame | None = None) -> DataFrame:
        """``pos, s, p, o, g`` of the page, decoded."""
        page = self.ranked() if page is None else page
        rows = pages.entity_rows(self.graph, page.select("s", "pos"), self.spec)
        return self.graph.decoded(rows.select("pos", "s", "p", "o", "g"), ["s", "p", "o", "g"])

    def paths(self, predicate: str, page: DataFrame | None = None) -> DataFrame:
        page = self.ranked() if page is None else page
        return pages.paths(self.graph, page.select("s"), predicate)

    def answers(self) -> DataFrame:
        """``id, properties, graph, paths`` of every match, without a page: maps of sorted objects and of ancestors by predicate.

        Assembled on the executors, so that the driver needn't hold what all matches have.
        """
        rows = pages.entity_rows(self.graph, self.matched.select("s"), self.spec).select("s", "p", "o", "g")
        each = self.graph.decoded(rows, ["s", "p", "o", "g"]).groupBy("s", "p").agg(F.sort_array(F.collect_set("o")).alias("o"), F.collect_set("g").alias("g"))
        out = each.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "o"))).alias("properties"), F.array_sort(F.array_remove(F.array_distinct(F.flatten(F.collect_list("g"))), "")).alias("graph"))
        for i, predicate in enumerate(self.spec.paths):
            flat = pages.paths(self.graph, self.matched.select("s"), predicate).select("s", F.posexplode_outer("path").alias("i", "o"))
            ways = self.graph.decoded(flat, ["s", "o"], iris=["o"]).groupBy("s").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "o")))).alias("_w"))
            out = out.join(ways.select("s", F.transform("_w", lambda x: x["o"]).alias(f"_w{i}")), "s", "left")
        ways = F.map_from_arrays(F.array(*map(F.lit, self.spec.paths)), F.array(*(f"_w{i}" for i in range(len(self.spec.paths))))) if self.spec.paths else F.create_map().cast("map<string,array<string>>")
        return out.select(F.col("s").alias("id"), "properties", "graph", F.map_filter(ways, lambda _, w: w.isNotNull()).alias("paths"))


class Engine:
    """Queries over a graph.

    ``embed`` turns texts into vectors for semantic filters; ``index`` serves full-text filters.
    """

    def __init__(self, graph: Graph, config: EngineConfig | None = None, embed: vectors.Embedder | None = None, index: fts.Index | None = None) -> None:
        self.graph, self.config, self.embed, self.index = graph, config or EngineConfig(), embed, index
        self.spark = graph.spark

    def plan(self, opts: dict) -> Plan:
        spec = parse(opts, self.config)
        texts = [f.text for f in spec.filters if f.kind == "semantic"]
        known = dict(zip(texts, self.embed(texts))) if texts and self.embed else {}
        return Plan(self.graph, spec, self.config, known, self.index)

    def query(self, opts: dict) -> dict:
        """The answer of a request: results, total, size, start and, if any were asked for, aggregates."""
        plan = self.plan(opts)
        spec = plan.spec
        plan.matched = plan.matched.persist()  # total, page and facets agree and share it
        try:
            out: dict = {"results": {}, "total": plan.matched.count(), "size": spec.size, "start": spec.start}
            found = {}
            for name in spec.aggregates:
                df = plan.facet(name)
                if df is not None:
                    found[name] = [(r["count"], r["value"]) for r in df.orderBy(F.desc("count"), "value").collect()]
            if found:
                out["aggregates"] = found
            if spec.size:
                page = self._small(plan.ranked().select("s", "pos"))
                out["results"] = self._assembled(plan, page)
            return out
        finally:
            plan.matched.unpersist()

    def _small(self, page: DataFrame) -> DataFrame:
        """The page as a local relation: at most ``size`` rows."""
        return self.spark.createDataFrame(page.collect(), page.schema)

    def _assembled(self, plan: Plan, page: DataFrame) -> dict:
        entities: dict[str, dict] = {}
        # a page's rows come to the driver anyway: its terms are looked up by their keys, without a join
        rows = sorted(pages.entity_rows(self.graph, F.broadcast(page.select("s", "pos")), plan.spec).collect(), key=lambda r: r["pos"])
        names = self.graph.names({r[c] for r in rows for c in "spog"})
        for r in rows:
            s, p, o, g = (names.get(r[c]) for c in "spog")
            e = entities.setdefault(s, {"id": s, "graph": set()})
            e.setdefault(p, set()).add(o)
            if g:
                e["graph"].add(g)
        out = {s: {k: sorted(v, key=str) if isinstance(v, set) else v for k, v in e.items()} for s, e in entities.items()}
        for predicate in plan.spec.paths:
            df = plan.paths(predicate, page)
            flat = df.select("s", F.posexplode_outer("path").alias("i", "o"))
            for r in sorted(self.graph.decoded(flat, ["s", "o"], iris=["o"]).collect(), key=lambda r: r["i"] or 0):
                if r["s"] in out:
                    way = out[r["s"]].setdefault("_paths", {}).setdefault(predicate, [])
                    if r["o"] is not None:
                        way.append(r["o"])
        return out

    # direct helpers

    def total(self) -> int:
        return facets.total(self.graph).first()["total"]

    def properties(self) -> dict[str, int]:
        return {r["value"]: r["count"] for r in facets.properties(self.graph).collect()}

    def count_by_property(self, predicate: str) -> dict[str, int]:
        return {r["value"]: r["count"] for r in facets.count_by_property(self.graph, predicate).collect()}

    def spo(self, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None, size: int | None = None, start: int = 0) -> list[tuple[str, str, str]]:
        df = pages.spo(self.graph, s, p, o, g).offset(start).limit(self.config.spo_size if size is None else size)
        return [tuple(r) for r in self.graph.decoded(df, ["s", "p", "o"]).collect()]

    def sp(self, subjects: list[str], p: str | None = None) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in self.graph.decoded(pages.sp(self.graph, subjects, p), ["s", "o"]).collect():
            out.setdefault(r["s"], []).append(r["o"])
        return out

    def raw(self, sql: str) -> DataFrame:
        """Any Spark SQL over ``triples``, ``iris`` and ``literals``."""
        self.graph.register()
        return self.spark.sql(sql)

    def random(self, n: int = 1) -> dict:
        return self.query({"filters": [{"p": "id", "o": f"random {n}"}]})

    def with_vectors(self, df: DataFrame) -> Engine:
        """This engine over a graph that has ``df(s, vec)`` as its vectors."""
        import copy

        graph = copy.copy(self.graph)
        graph._vectors = df
        return Engine(graph, replace(self.config), self.embed, self.index)
