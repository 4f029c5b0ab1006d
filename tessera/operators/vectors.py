"""Vectors: documents of subjects, embeddings through a plug-in, cosine search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.graph import Graph
from ..plans.materialize import materialized, ship

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 96
#: A key on more rows than the larger of OFTEN and one in MOST_OFTEN of them is joined by broadcast.
OFTEN, MOST_OFTEN = 10_000, 10_000
#: Quads for each task that gathers subjects or joins objects.
TASK_ROWS = 250_000


def hashing_embedder(dim: int = 1024) -> Embedder:
    """A deterministic offline embedder: signed hashes of words."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def subject_documents(graph: Graph) -> DataFrame:
    """``s, values``: a subject's own distinct literals, and its direct objects' documents, by tabs."""
    q = graph.quads().select("s", "o")
    rows = {True: q, False: q}  # those with a literal, and the others, as far as the keys tell them apart
    if graph.inline:
        rows = {x: q.where(F.col("o").startswith('"') == x) for x in rows}
    often = _often(rows[False])
    n = 1 + q.count() // TASK_ROWS  # told, so that adaptive execution joins no small partitions to large ones
    texts = rows[True].withColumn("value", F.col("o")) if graph.inline else _joined(q, graph.literals().withColumnRenamed("key", "o"), often, n)
    # what one subject has comes together first: subjects repeat within no task before
    own = texts.select("s", "value").repartition(n, "s").dropDuplicates().groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("own"))
    linked = _joined(rows[False], own.select(F.col("s").alias("o"), F.col("own").alias("below")), often, n, True)
    below = linked.select("s", "below").repartition(n, "s").groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("below")), "\n").alias("below"))
    both = F.array_distinct(F.array_compact(F.array("own", "below")))
    return own.join(below, "s", "full").select("s", F.array_join(F.sort_array(both), "\t").alias("values"))


def _often(rows: DataFrame) -> DataFrame:
    """``o`` of very many of ``rows(s, o)``: at most MOST_OFTEN keys."""
    counted = materialized(rows.groupBy("o").agg(F.count("*").alias("n")), "counted")
    least = max(OFTEN, (counted.agg(F.sum("n")).first()[0] or 0) // MOST_OFTEN)
    return F.broadcast(counted.where(F.col("n") > least).select("o"))


def _joined(rows: DataFrame, values: DataFrame, often: DataFrame, n: int, distinct: bool = False) -> DataFrame:
    """``rows(s, o)``, made distinct if so told, with ``values(o, ...)``, one row a key.

    Keys that stand on very many rows are joined by broadcast, so that no task gets all rows of one.
    """
    few = F.broadcast(materialized(values.join(often, "o", "left_semi"), "often"))
    light, heavy = rows.join(often, "o", "left_anti"), rows.join(few.select("o"), "o", "left_semi")
    if distinct:
        light, heavy = (x.select("s", "o").repartition(n, "s").dropDuplicates() for x in (light, heavy))
    return light.repartition(n, "o").join(values.repartition(n, "o"), "o").unionByName(heavy.join(few, "o"))


def build(documents: DataFrame, embed: Embedder, batch: int = BATCH) -> DataFrame:
    """``s, vec`` of ``documents(s, values)``, embedded in batches on the executors."""
    ship(documents.sparkSession)
    schema = T.StructType([documents.schema["s"], T.StructField("vec", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                yield pd.DataFrame({"s": part["s"], "vec": [np.asarray(v, np.float32) for v in embed(part["values"].tolist())]})

    return documents.select("s", "values").mapInPandas(run, schema)


def nearest(vectors: DataFrame, query: list[float], distance: float) -> DataFrame:
    """``s, score`` of the vectors nearer than ``distance``; the score is one over the cosine distance, infinite at 0."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf(T.DoubleType())
    def cosine(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        m = np.stack([np.asarray(x, float) for x in v])
        return pd.Series(m @ q / np.maximum(np.linalg.norm(m, axis=1), 1e-300))

    d = vectors.where(F.col("vec").isNotNull() & (F.size("vec") == len(q))).select("s", (1 - F.least(cosine("vec"), F.lit(1.0))).alias("d"))
    return d.where(F.col("d") < distance).select("s", F.when(F.col("d") <= 1e-12, F.lit(float("inf"))).otherwise(1 / F.col("d")).alias("score"))
