"""Streaming ingest: N-Triples files that appear in a folder are added to a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import ntriples
from ..sources.store import TERMS, TEXT_QUADS, TripleStore, encoded, new_terms


def lines(spark: SparkSession, path: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.format("text").option("lineSep", "\n").option("maxFilesPerTrigger", max_files).load(path)


def append(store: TripleStore, quads: DataFrame) -> None:
    """Add a batch of text quads: quads the store lacks, terms its dictionaries lack."""
    m = store._manifest()
    staged = store._write(quads.select(*"spog").distinct(), "staged")
    text = store._read([staged], TEXT_QUADS)
    have = store._quads(m)
    fresh = encoded(text).join(have, [*"spog"], "left_anti")
    m["triples"] = [*m["triples"], store._write(fresh, "triples", "p", "o")]
    for kind, literal in (("iris", False), ("literals", True)):
        terms = new_terms(text, store._read(m[kind], TERMS)).where(F.col("value").startswith('"') == literal)
        m[kind] = [*m[kind], store._write(terms, kind, "hash")]
    store._commit(m)
    store._drop(staged)


def ingest(spark: SparkSession, source: str, store: TripleStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the stream; a batch that is run again adds nothing twice."""
    w = ntriples.parse_lines(lines(spark, source)).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append(store, df))
    return (w.trigger(availableNow=True) if once else w).start()
