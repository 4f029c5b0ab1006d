"""Graphs: where quads come from, and what a term's key is.

A *stored* graph keys terms by their identity hashes and decodes through dictionaries.  A *virtual*
graph derives quads from other tables; its keys are the terms themselves, so nothing need be
decoded and a bound predicate prunes the union to single column-pruned scans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import hash_term, unsigned_order
from .materialize import materialized

#: At most so many keys are broadcast to the dictionaries.
FEW_TERMS = 50_000


class Graph:
    """Quads ``s, p, o, g`` of keys."""

    spark: SparkSession
    version: str = "0"
    #: Whether literals stand in the quads themselves, so that they can be read in place.
    inline = False

    def quads(self) -> DataFrame:
        raise NotImplementedError

    def repeated(self) -> DataFrame:
        """The quads, some perhaps more than once: for what doesn't count them."""
        return self.quads()

    def identity(self, c: str) -> list[Column]:
        """A short key column or more by which the keys of a column can be told apart."""
        return [F.col(c)]

    def by_subject(self) -> DataFrame:
        """The quads, from a copy clustered by subject if there is one."""
        return self.quads()

    def names(self, keys: set) -> dict:
        """Terms by key, of a bounded set of keys."""
        return {k: k for k in keys}

    def key(self, term: str) -> Column:
        raise NotImplementedError

    def order_key(self, c: Column | str) -> Column:
        """The order of keys that ties are broken by."""
        raise NotImplementedError

    def literals(self, predicate: str | None = None) -> DataFrame:
        """``key, value`` of the distinct literals, or only those under a predicate."""
        raise NotImplementedError

    def decoded(self, df: DataFrame, columns: Iterable[str], iris: Iterable[str] = ()) -> DataFrame:
        """``df`` with the key columns replaced by their terms; null where a dictionary lacks one.

        Columns ``s``, ``p`` and ``g``, and those named in ``iris``, hold no literals.
        """
        raise NotImplementedError

    def is_iri(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose key is no literal."""
        raise NotImplementedError

    def isin(self, c: Column | str, terms: Iterable[str]) -> Column:
        keys = [self.key(t) for t in terms]
        c = F.col(c) if isinstance(c, str) else c
        return c == keys[0] if len(keys) == 1 else c.isin(*keys)

    def vectors(self) -> DataFrame | None:
        """``s, vec``, if the graph has vectors."""
        return None

    def register(self) -> None:
        """Temp views ``triples``, ``iris``, ``literals`` for plain SQL."""
        self.quads().createOrReplaceTempView("triples")


class VirtualGraph(Graph):
    inline = True

    def __init__(self, quads: DataFrame, vectors: DataFrame | None = None, repeated: DataFrame | None = None) -> None:
        self._quads, self._vectors, self.spark = quads, vectors, quads.sparkSession
        self._repeated = quads if repeated is None else repeated

    def quads(self) -> DataFrame:
        return self._quads

    def repeated(self) -> DataFrame:
        return self._repeated

    def identity(self, c: str) -> list[Column]:
        return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]  # 128 bits

    def key(self, term: str) -> Column:
        return F.lit(term)

    def order_key(self, c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    def literals(self, predicate: str | None = None) -> DataFrame:
        q = self._quads if predicate is None else self._quads.where(F.col("p") == predicate)
        return q.where(F.col("o").startswith('"')).select(F.col("o").alias("key"), F.col("o").alias("value")).distinct()

    def decoded(self, df: DataFrame, columns: Iterable[str], iris: Iterable[str] = ()) -> DataFrame:
        return df

    def is_iri(self, df: DataFrame, column: str) -> DataFrame:
        return df.where(~F.col(column).startswith('"'))

    def vectors(self) -> DataFrame | None:
        return self._vectors

    def register(self) -> None:
        self._quads.createOrReplaceTempView("triples")
        terms = self._quads.select(F.explode(F.array("s", "p", "o", "g")).alias("value")).where("value <> ''").distinct()
        both = terms.select(F.col("value").alias("hash"), "value")
        both.where(~F.col("value").startswith('"')).createOrReplaceTempView("iris")
        both.where(F.col("value").startswith('"')).createOrReplaceTempView("literals")


class StoredGraph(Graph):
    """Hashed quads with dictionaries ``iris`` and ``literals`` (``hash, value``)."""

    def __init__(self, quads: DataFrame, iris: DataFrame, literals: DataFrame, vectors: DataFrame | None = None, version: str = "0", by_subject: DataFrame | None = None) -> None:
        self._by_subject = quads if by_subject is None else by_subject
        self._quads, self._iris, self._literals, self._vectors = quads, iris, literals, vectors
        self.spark, self.version = quads.sparkSession, version

    def quads(self) -> DataFrame:
        return self._quads

    def key(self, term: str) -> Column:
        return F.lit(hash_term(term)).cast("long")

    def order_key(self, c: Column | str) -> Column:
        return unsigned_order(c)

    def literals(self, predicate: str | None = None) -> DataFrame:
        every = self._literals.select(F.col("hash").alias("key"), "value")
        if predicate is None:
            return every
        return every.join(self._quads.where(F.col("p") == self.key(predicate)).select(F.col("o").alias("key")), "key", "left_semi")

    def by_subject(self) -> DataFrame:
        return self._by_subject

    def _terms(self) -> DataFrame:
        return self._iris.select("hash", "value").union(self._literals.select("hash", "value"))

    def names(self, keys: set) -> dict:
        out: dict = {}
        wanted = sorted(k for k in keys if k is not None)
        for i in range(0, len(wanted), 10_000):
            out |= {r["hash"]: r["value"] for r in self._terms().where(F.col("hash").isin(*wanted[i : i + 10_000])).collect()}
        return out

    def decoded(self, df: DataFrame, columns: Iterable[str], iris: Iterable[str] = ()) -> DataFrame:
        order, columns, no_literals = df.columns, list(columns), {*"spg", *iris}
        plain = [c for c in columns if c in no_literals]
        df = self._looked_up(df, plain, self._iris)
        return self._looked_up(df, [c for c in columns if c not in plain], self._terms()).select(*order)

    def _looked_up(self, df: DataFrame, columns: list[str], terms: DataFrame) -> DataFrame:
        """One pass over the dictionaries for all columns; where few terms are wanted, no dictionary is shuffled."""
        if not columns:
            return df
        wanted = materialized(df.select(F.explode(F.array(*columns)).alias("hash")).distinct(), "wanted")
        few = wanted.limit(FEW_TERMS + 1).count() <= FEW_TERMS
        # a term may stand in both dictionaries, with the same text
        names = terms.select("hash", "value").join(F.broadcast(wanted) if few else wanted, "hash", "left_semi").groupBy("hash").agg(F.min("value").alias("value"))
        for c in columns:
            df = df.join(names.select(F.col("hash").alias(c), F.col("value").alias(f"_{c}")), c, "left").drop(c).withColumnRenamed(f"_{c}", c)
        return df

    def is_iri(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self._iris.select(F.col("hash").alias(column)), column, "left_semi")

    def vectors(self) -> DataFrame | None:
        return self._vectors

    def register(self) -> None:
        self._quads.createOrReplaceTempView("triples")
        self._iris.createOrReplaceTempView("iris")
        self._literals.createOrReplaceTempView("literals")
