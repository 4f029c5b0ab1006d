"""Full-text search: conjunctive BM25 over literals.

Without an index a search is two scans of the literals: term counts come from the token array of each
row, and the corpus figures are one aggregation.  Where literals stand in the quads, rows are scored
in place and no text is shuffled.  ``Index`` keeps
postings as tables clustered by term, so that a search reads only its terms' row groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FtsConfig
from ..functions.text import folded, query_tokens, tokens
from ..plans.materialize import ship


def _bm25(tf: Column, length: Column, n: float, df: float, avgdl: float, c: FtsConfig) -> Column:
    idf = F.log10(F.lit((n - df + 0.5) / (df + 0.5) + 1.0))
    return idf * tf * (c.k + 1) / (tf + c.k * (1 - c.b + c.b * length / F.lit(avgdl)))


def _counts(terms: list[str]) -> list[Column]:
    """How often each term stands in the tokens ``t``."""

    def count(word: str) -> Column:
        return F.size(F.filter("t", lambda x: x == word))

    return [count(w).alias(f"tf{i}") for i, w in enumerate(terms)]


def _scored(d: DataFrame, terms: list[str], figures: tuple, config: FtsConfig, keep: list[str]) -> DataFrame:
    """``keep`` and ``score`` of the rows of ``d(keep, value)`` that have all terms."""
    n, avgdl, *df = figures
    if config.stemmer == "none":  # a row without a term's letters needn't be cut into tokens
        for w in terms:
            d = d.where(folded(F.col("value")).contains(w))
    counted = d.select(*keep, tokens(F.col("value"), config).alias("t")).select(*keep, F.size("t").alias("len"), *_counts(terms))
    hit = F.lit(True)
    for i in range(len(terms)):
        hit = hit & (F.col(f"tf{i}") > 0)
    score = sum((_bm25(F.col(f"tf{i}"), F.col("len"), n, x, avgdl or 1.0, config) for i, x in enumerate(df)), F.lit(0.0))
    return counted.where(hit).select(*keep, score.alias("score"))


def _figures(counted: DataFrame, terms: list[str]) -> tuple:
    return tuple(counted.agg(F.count("*"), F.avg("len"), *(F.count_if(F.col(f"tf{i}") > 0) for i in range(len(terms)))).first())


def search(docs: DataFrame, query: str, config: FtsConfig) -> DataFrame:
    """``key, score`` of the rows of ``docs(key, value)`` that have all terms of the query; every row is a text of its own."""
    ship(docs.sparkSession)
    terms = query_tokens(query, config)
    if not terms:
        return docs.where(F.lit(False)).select("key", F.lit(0.0).alias("score"))
    counted = docs.select(tokens(F.col("value"), config).alias("t")).select(F.size("t").alias("len"), *_counts(terms))
    return _scored(docs, terms, _figures(counted, terms), config, ["key"])


def search_in_place(texts: DataFrame, rows: DataFrame, query: str, config: FtsConfig) -> DataFrame:
    """``s, score`` of ``rows(s, value)``; the corpus is the distinct texts of ``texts(value)``.

    Texts are told apart by 128 bits of hashes, which are shuffled with the counts in place of the texts.
    """
    ship(rows.sparkSession)
    terms = query_tokens(query, config)
    if not terms:
        return rows.where(F.lit(False)).select("s", F.lit(0.0).alias("score"))
    address = [F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2")]
    counted = texts.select(*address, tokens(F.col("value"), config).alias("t")).select("h1", "h2", F.size("t").alias("len"), *_counts(terms))
    once = counted.groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in counted.columns[2:]))
    return _scored(rows, terms, _figures(once, terms), config, ["s"]).groupBy("s").agg(F.max("score").alias("score"))


@dataclass
class Index:
    """Postings ``term, key, tf, len`` clustered by term, ``terms(term, df)``, and the corpus figures."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    config: FtsConfig

    @staticmethod
    def build(docs: DataFrame, config: FtsConfig, path: str, partitions: int | None = None) -> Index:
        """Index ``docs(key, value)``, each key on one row, into tables under ``path``."""
        spark = docs.sparkSession
        ship(spark)
        d = docs.select("key", tokens(F.col("value"), config).alias("t"))
        d.select("key", F.size("t").alias("len")).write.mode("overwrite").parquet(f"{path}/docs")
        # a key is one row: its terms are counted within the row, as runs of the sorted tokens
        runs = d.where(F.size("t") > 0).select("key", F.sort_array("t").alias("t"), F.size("t").alias("len"))
        starts = F.filter(F.sequence(F.lit(1), F.col("len")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
        runs = runs.select("key", "t", "len", F.concat(starts, F.array(F.col("len") + 1)).alias("at"))
        each = F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda j: F.struct(F.element_at("t", F.element_at("at", j)).alias("term"), (F.element_at("at", j + 1) - F.element_at("at", j)).alias("tf")))
        p = runs.select("key", "len", F.inline(each)).select("term", "key", "tf", "len")
        # ranges cut by term and key: a term of a third of all rows spreads over many files
        p = p.repartitionByRange(*([partitions] if partitions else []), "term", "key").sortWithinPartitions("term", "key")
        p.write.mode("overwrite").parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
        return Index.open(spark, config, path)

    @staticmethod
    def open(spark: SparkSession, config: FtsConfig, path: str) -> Index:
        n, avgdl = spark.read.parquet(f"{path}/docs").agg(F.count("*"), F.avg("len")).first()
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), n, avgdl or 1.0, config)

    def search(self, query: str) -> DataFrame:
        terms = query_tokens(query, self.config)
        df = {r["term"]: r["df"] for r in self.terms.where(F.col("term").isin(*terms)).collect()} if terms else {}
        if not terms or len(df) < len(terms):
            return self.postings.where(F.lit(False)).select("key", F.lit(0.0).alias("score"))
        part = F.lit(None).cast("double")
        for w in terms:
            part = F.when(F.col("term") == w, _bm25(F.col("tf"), F.col("len"), self.n, df[w], self.avgdl, self.config)).otherwise(part)
        scored = self.postings.where(F.col("term").isin(*terms)).select("key", part.alias("x"))
        return scored.groupBy("key").agg(F.count("*").alias("m"), F.sum("x").alias("score")).where(F.col("m") == len(terms)).select("key", "score")
