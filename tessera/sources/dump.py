"""Offline dumps: hash triples of line files, and an exact term map that grows by what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ntriples
from .store import dictionary, encoded, new_terms


def hash_dump(spark: SparkSession, paths: list[str], out: str) -> None:
    """Write the hash triples ``s, p, o`` of all lines, clustered by predicate and object."""
    encoded(ntriples.read(spark, paths, graphs=False)).select("s", "p", "o").repartitionByRange("p", "o").sortWithinPartitions("p", "o").write.parquet(out)


def term_map(spark: SparkSession, paths: list[str], out: str, known: str | None = None) -> DataFrame:
    """Append ``hash, value`` of the terms that the map under ``known`` lacks."""
    quads = ntriples.read(spark, paths, graphs=False)
    terms = dictionary(quads) if known is None else new_terms(quads, spark.read.parquet(known))
    terms.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("append").parquet(out)
    return spark.read.parquet(out)


def similar_items(triples: DataFrame, seed: int, more_than: int = 10) -> DataFrame:
    """``s, p_cnt``: subjects of a hash dump that share more than so many (p, o) pairs with the seed."""
    own = triples.where(F.col("s") == F.lit(seed).cast("long")).select("p", "o")
    return triples.join(own, ["p", "o"]).groupBy("s").agg(F.count("*").alias("p_cnt")).where(F.col("p_cnt") > more_than)
