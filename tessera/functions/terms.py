"""RDF terms as columns: identity hashes, literal parts, escapes.

The identity of a term is XXH64 with seed 0 of its UTF-8 text, held in a signed long.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LONG = -(1 << 63)
_ESCAPE = re.compile(r"\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})")


def hash_term(term: str) -> int:
    """The signed identity hash of one term."""
    import xxhash

    h = xxhash.xxh64_intdigest(term.encode(), 0)
    return h - (1 << 64) if h >= 1 << 63 else h


def hash_column(c: Column | str) -> Column:
    """The identity hash of a string column, inside the JVM; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    jvm = SparkSession.getActiveSession()._jvm
    sql = jvm.org.apache.spark.sql
    try:
        args = jvm.java.util.ArrayList()
        args.add(sql.classic.ExpressionUtils.expression(c._jc))
        expression = sql.catalyst.expressions.XxHash64(jvm.scala.jdk.javaapi.CollectionConverters.asScala(args).toSeq(), 0)
        hashed = Column(sql.classic.ExpressionUtils.column(expression))
    except Exception:  # internal API: another Spark may not have it
        hashed = _hash_udf(c)
    return F.when(c.isNotNull(), hashed)


@F.pandas_udf(T.LongType())
def _hash_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else hash_term(t)).astype("Int64")


def unsigned_order(c: Column | str) -> Column:
    """A key that orders signed hashes as the unsigned numbers they stand for."""
    c = F.col(c) if isinstance(c, str) else c
    return c.bitwiseXOR(F.lit(MIN_LONG))


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def literal_value(c: Column) -> Column:
    """The text between a literal's first and last quote; null for other terms."""
    return F.when(c.rlike(r'(?s)^".*"'), F.regexp_extract(c, r'(?s)^"(.*)"', 1))


def literal_language(c: Column) -> Column:
    tail = F.trim(F.regexp_extract(c, r'(?s)^".*"(.*)$', 1))
    return F.when(tail.startswith("@"), F.substring(tail, 2, 1 << 20))


def literal_datatype(c: Column) -> Column:
    tail = F.trim(F.regexp_extract(c, r'(?s)^".*"(.*)$', 1))
    return F.when(tail.startswith("^^"), F.substring(tail, 3, 1 << 20))


def split_literal(term: str) -> tuple[str | None, str | None, str | None]:
    """``(value, language, datatype)`` of one term; Nones for what isn't a literal."""
    last = term.rfind('"')
    if not term.startswith('"') or last < 1:
        return None, None, None
    tail = term[last + 1 :].strip()
    return term[1:last], tail[1:] if tail[:1] == "@" else None, tail[2:] if tail[:2] == "^^" else None


def unescape(text: str) -> str | None:
    """Decode long, then short Unicode escapes; None if the result isn't valid Unicode."""
    for size in (8, 4):
        text = re.sub(rf"\\{'U' if size == 8 else 'u'}([0-9A-Fa-f]{{{size}}})", lambda m: chr(n) if (n := int(m[1], 16)) < 0x110000 else m[0], text)
    try:
        text.encode()
    except UnicodeEncodeError:
        try:  # a surrogate pair in two short escapes is one character
            return text.encode("utf-16", "surrogatepass").decode("utf-16")
        except UnicodeDecodeError:
            return None
    return text


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unescape(t))


def unescaped(c: Column) -> Column:
    """``unescape`` of a column; Python sees only rows with an escape."""
    has = c.contains("\\u") | c.contains("\\U")
    return F.when(has, _unescape_udf(F.when(has, c))).otherwise(c)
