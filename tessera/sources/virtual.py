"""Relational tables as quads: every predicate is its own projection with a literal predicate.

The expressions are SQL that both Spark and other engines read.  A filter on one predicate leaves one
column-pruned scan of the union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RDF_TYPE, RDFS_LABEL, XSD
from ..plans.graph import VirtualGraph

B = "http://t.example/"


def prop(name: str) -> str:
    return {"type": RDF_TYPE, "label": RDFS_LABEL}.get(name, f"<{B}{name}>")


def _iri(kind: str, *columns: str) -> str:
    path = ", '/', ".join(f"cast({c} as string)" for c in columns)
    return f"concat('<{B}{kind}/', {path}, '>')"


def _text(c: str) -> str:
    esc = f"replace(replace(replace({c}, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"
    return f"concat(chr(34), {esc}, chr(34))"


def _int(e: str) -> str:
    return f"concat(chr(34), cast({e} as string), chr(34), '^^<{XSD}integer>')"


def _cents(c: str) -> str:
    return _int(f"cast(round({c} * 100) as bigint)")


def _date(c: str) -> str:
    return f"concat(chr(34), cast(cast({c} as date) as string), chr(34), '^^<{XSD}date>')"


#: source table -> (subject, graph, {predicate: object}, distinct)
TABLES: dict[str, tuple[str, str, dict[str, str], bool]] = {
    "region": (_iri("region", "r_regionkey"), "''", {"type": f"'<{B}Region>'", "label": _text("r_name")}, False),
    "nation": (_iri("nation", "n_nationkey"), "''", {"type": f"'<{B}Nation>'", "label": _text("n_name"), "partOf": _iri("region", "n_regionkey")}, False),
    "supplier": (_iri("supplier", "s_suppkey"), "''", {"type": f"'<{B}Supplier>'", "label": _text("s_name"), "nation": _iri("nation", "s_nationkey"), "partOf": _iri("nation", "s_nationkey"), "balance": _cents("s_acctbal")}, False),
    "customer": (_iri("customer", "c_custkey"), "''", {"type": f"'<{B}Customer>'", "label": _text("c_name"), "nation": _iri("nation", "c_nationkey"), "partOf": _iri("nation", "c_nationkey"), "mktsegment": _text("c_mktsegment"), "balance": _cents("c_acctbal")}, False),
    "part": (_iri("part", "p_partkey"), "''", {"type": f"'<{B}Part>'", "label": _text("p_name"), "brand": _text("p_brand"), "ptype": _text("p_type"), "size": _int("p_size"), "price": _cents("p_retailprice")}, False),
    "orders": (_iri("order", "o_orderkey"), "''", {"type": f"'<{B}Order>'", "customer": _iri("customer", "o_custkey"), "status": _text("o_orderstatus"), "priority": _text("o_orderpriority"), "total": _cents("o_totalprice"), "date": _date("o_orderdate")}, False),
    "lineitem": (_iri("order", "l_orderkey"), "''", {"hasPart": _iri("part", "l_partkey"), "hasSupplier": _iri("supplier", "l_suppkey")}, True),
    "documents": (_iri("doc", "doc_id"), f"concat('<{B}graph/', source, '>')", {"type": f"'<{B}Document>'", "text": f"concat({_text('text')}, '@', lang)", "length": _int("n_chars")}, False),
    "labels": ("concat('_:label', cast(doc_id as string))", "''", {"about": _iri("doc", "doc_id"), "quality": _int("quality"), "toxic": _int("toxic")}, False),
    "conversations": (_iri("conv", "conv_id", "turn"), "''", {"type": f"'<{B}Turn>'", "role": _text("role"), "text": _text("text")}, False),
    "events": (_iri("event", "event_id"), "''", {"type": f"'<{B}Event>'", "etype": _text("event_type"), "user": _int("user_id")}, False),
    "pages": (_iri("page", "page_id"), "''", {"type": f"'<{B}Page>'", "url": _text("url")}, False),
    "benchmark": (_iri("item", "item_id"), "''", {"text": _text("text")}, False),
    "embeddings": (_iri("vec", "vec_id"), "''", {"vlabel": _int("label")}, False),
}


def quads(spark: SparkSession, sf_dir: str, tables: list[str], repeated: bool = False) -> DataFrame:
    """The quads of some tables; rows with a null part aren't quads.  ``repeated`` leaves equal rows in."""
    parts = []
    for t in tables:
        s, g, props, distinct = TABLES[t]
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        for name, o in props.items():
            q = df.select(F.expr(s).alias("s"), F.lit(prop(name)).alias("p"), F.expr(o).alias("o"), F.expr(g).alias("g")).where("s is not null and o is not null and g is not null")
            parts.append(q.distinct() if distinct and not repeated else q)
    return reduce(DataFrame.union, parts)


def graph(spark: SparkSession, sf_dir: str, tables: list[str]) -> VirtualGraph:
    vectors = None
    if "embeddings" in tables:
        s = TABLES["embeddings"][0]
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(s).alias("s"), F.col("embedding").alias("vec"))
    return VirtualGraph(quads(spark, sf_dir, tables), vectors, quads(spark, sf_dir, tables, True))


def sql(tables: list[str]) -> str:
    """The same quads as one SQL query over views of the same names."""
    parts = []
    for t in tables:
        s, g, props, distinct = TABLES[t]
        for name, o in props.items():
            parts.append(f"select {'distinct ' if distinct else ''}* from (select {s} as s, '{prop(name)}' as p, {o} as o, {g} as g from {t}) where s is not null and o is not null and g is not null")
    return " union all ".join(parts)
