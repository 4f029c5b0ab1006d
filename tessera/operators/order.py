"""Ordering subjects by score, label, property or the label of an object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RDFS_LABEL, EngineConfig
from ..plans.graph import Graph
from ..plans.spec import OrderRule

_FIRST = {"collapse_space": (r"(?s)^(.*?)\s+", "$1 "), "strip_punct": (r"^[^0-9A-Za-z]+", "")}


def language_rank(value: Column, languages: tuple[str, ...]) -> Column:
    """1.. for the listed languages, then untagged literals, then all others."""
    rank = None
    for i, lang in enumerate(languages, 1):
        test = value.endswith(f'"@{lang}')
        rank = F.when(test, i) if rank is None else rank.when(test, i)
    rest = F.when(~value.contains('"@'), len(languages) + 1).otherwise(len(languages) + 2)
    return rest if rank is None else rank.otherwise(rest)


def cleaned(value: Column, rule: OrderRule) -> Column:
    """The sort label of a literal."""
    c = {"remove_quotes": False, "collapse_space": False, "strip_punct": False, "trim": True, "lower": True} | rule.clean
    out = F.regexp_extract(value, r'^"(.+)"', 1)
    if c["remove_quotes"]:
        out = F.regexp_replace(out, r'(?s)^(.*?)"', "$1")
    for name in ("collapse_space", "strip_punct"):
        if c[name]:
            out = F.regexp_replace(out, *_FIRST[name])
    if c["trim"]:
        out = F.trim(out)
    return F.lower(out) if c["lower"] and rule.mode == "lex" else out


def labels(graph: Graph, subjects: DataFrame, rule: OrderRule, config: EngineConfig) -> DataFrame:
    """``s, sort_label``: the best label of each subject that has one, by language, then text."""
    q = graph.quads()
    if rule.by == "object_label":
        via = q.where(F.col("p") == graph.key(rule.via)).select("s", F.col("o").alias("_x"))
        lab = q.where(F.col("p") == graph.key(RDFS_LABEL)).select(F.col("s").alias("_x"), "o")
        pairs = via.join(subjects.select("s"), "s", "left_semi").join(lab, "_x").select("s", "o")
    else:
        prop = rule.prop if rule.by == "property" else RDFS_LABEL
        pairs = q.where(F.col("p") == graph.key(prop)).join(subjects.select("s"), "s", "left_semi").select("s", "o")
    decoded = graph.decoded(pairs, ["o"]).where(F.col("o").startswith('"'))
    rank = language_rank(F.col("o"), rule.lang or config.languages)
    best = decoded.groupBy("s").agg(F.min(F.struct(rank.alias("rank"), cleaned(F.col("o"), rule).alias("sort_label"))).alias("b"))
    return best.select("s", F.col("b.sort_label").alias("sort_label"))


def keys(graph: Graph, rule: OrderRule | None, scored: bool) -> list[Column]:
    """Sort keys over ``s``, and ``sort_label`` or ``score``."""
    tie = graph.order_key("s").asc()
    if rule is None:
        return [F.col("score").desc_nulls_last(), tie] if scored else [tie]
    label = F.col("sort_label")
    down = rule.dir == "desc"
    way = (lambda c: c.desc_nulls_last()) if down else (lambda c: c.asc_nulls_last())
    if rule.natural:
        number = F.nullif(F.regexp_extract(label, r"^(\d+)", 1), F.lit("")).try_cast("int")
        return [label.isNull().asc(), number.isNull().asc(), way(number), way(label), tie]
    nulls = label.isNull().desc() if rule.nulls == "first" else label.isNull().asc()
    return [nulls, way(label), tie]


def ordered(graph: Graph, matched: DataFrame, rule: OrderRule | None, config: EngineConfig) -> tuple[DataFrame, list[Column]]:
    """``matched`` with what its order needs, and the order's keys."""
    if rule is not None:
        matched = matched.join(labels(graph, matched, rule, config), "s", "left")
    return matched, keys(graph, rule, "score" in matched.columns)
