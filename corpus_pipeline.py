"""The corpus pipeline: quality rules, near-dedup, decontamination, PII masking, mixing.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of the documents.  ``run`` writes each stage's result
as Parquet in the shared folder and reads it again for the next.

Defined results, for all stages: rows whose id is null, or whose text has no words, can't be named as
duplicates, and a text without words fails the quality rules; rows are removed by their own text, so an
id on several texts loses only those that go, and of rows that repeat id and text near-dedup keeps one;
very long texts are read whole; ties follow the operators' docstrings (the smallest id of a group
stays); empty tables give empty results; other columns pass through all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, mixing, neardup, pii, rules
from tessera.llm.store import read, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return rules.select(docs, rules.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates."""
    return neardup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training blocks, a row a slot of an output shard."""
    return mixing.blocks(docs)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("PII masking", mask_pii), ("mixing", mix)]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
