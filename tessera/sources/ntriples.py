"""Reading N-Triples, and TriG as far as graph headers go: ``s, p, o, g`` of text.

A line is a triple if it ends in space and full stop, its first word is an IRI or blank node and its
second an IRI; all else is skipped.  A line ``<graph> {`` names the graph of the lines after it, up
to the file's next such line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import unescaped
from ..plans.materialize import ship

_TRIPLE = r"(?s)^(<[^ >]*>|_:[^ ]+) (<[^ >]*>) (.+) \.$"
_HEADER = r"^(<[^ >]*>) \{$"
SUFFIXES = (".nt", ".nt.gz", ".nt.bz2", ".trig", ".trig.gz", ".trig.bz2", ".gz", ".bz2")


def parsed(line: Column) -> dict[str, Column]:
    """The parts of a decoded line; empty where it is no triple."""
    return {c: F.regexp_extract(line, _TRIPLE, i) for i, c in enumerate("spo", 1)}


def parse_lines(lines: DataFrame, column: str = "value", graph: Column | None = None) -> DataFrame:
    """``s, p, o, g`` of the triples among ``lines``."""
    ship(lines.sparkSession)
    v = F.col(column)
    likely = lines.where(v.endswith(" .") & (v.startswith("<") | v.startswith("_:")))
    d = likely.select(unescaped(v).alias("_line"), (F.lit("") if graph is None else graph).alias("g")).where(F.col("_line").isNotNull())
    return d.select(*(c.alias(n) for n, c in parsed(F.col("_line")).items()), "g").where(F.col("s") != "").select("s", "p", "o", "g")


def _with_graphs(lines: DataFrame) -> DataFrame:
    """Each line's graph: the last header of its block before it, else the last of the file's blocks before.

    Blocks are splits of the input, so no task orders more than one split; files are chained over blocks only.
    """
    block = ["_file", "_block"]
    d = lines.withColumn("_head", F.when(F.col("value").rlike(_HEADER), F.regexp_extract("value", _HEADER, 1)))
    d = d.withColumn("_own", F.last("_head", ignorenulls=True).over(W.partitionBy(*block).orderBy("_id").rowsBetween(W.unboundedPreceding, 0)))
    ends = d.where(F.col("_head").isNotNull()).groupBy(*block).agg(F.max(F.struct("_id", "_head")).alias("e")).select(*block, F.col("e._head").alias("_end"))
    blocks = d.select(*block).distinct().join(ends, block, "left")
    carry = blocks.withColumn("_carry", F.last("_end", ignorenulls=True).over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).select(*block, "_carry")
    return d.join(carry, block).select("value", F.coalesce("_own", "_carry", F.lit("")).alias("g"))


def read(spark: SparkSession, paths: list[str], graphs: bool | None = None) -> DataFrame:
    """The triples of files or directories; compressed files by suffix.

    ``graphs`` says whether to look for graph headers; by default, if a path names TriG.
    """
    if not isinstance(paths, (list, tuple)):
        raise TypeError("paths must be a list")
    if graphs is None:
        graphs = any(".trig" in p for p in paths)
    lines = spark.read.text([*paths], lineSep="\n")
    if not graphs:
        return parse_lines(lines)
    lines = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return parse_lines(_with_graphs(lines), graph=F.col("g"))


def to_line(s: str, p: str, o: str) -> str:
    return f"{s} {p} {o} ."


def is_source(name: str) -> bool:
    return bool(re.search(r"\.(nt|trig)(\.(gz|bz2))?$|\.gz$", name))
