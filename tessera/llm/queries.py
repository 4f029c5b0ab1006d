"""The queries of this package: ``opN_<name>``, ``pipeline`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, licenses, mixing, neardup, pii, ppm, rules, secrets
from .store import read


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), ["doc_id"])


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = ppm.split(F.col("doc_id"), 5, 1)
    scored = ppm.score(docs, ppm.train(docs.where(~held_out)), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, read(spark, sf_dir, "labels")), ["doc_id"])


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = ppm.split(F.col("doc_id"), 5, 0)
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.scan(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"), ["doc_id"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the ledger that the setting ``spark.tessera.secrets.ledger`` names, if it does; else all blobs are unseen."""
    docs, folder = read(spark, sf_dir, "documents"), spark.conf.get("spark.tessera.secrets.ledger", None)
    return secrets.scan_kept(docs, "doc_id", folder) if folder else secrets.scan(docs, "doc_id")[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_licenses, op2_neardup, op3_ppm, op4_decontam, op5_mixing, op6_langid, op7_html, op8_pii, op9_quality, op10_secrets)}
#: The others can't be said in SQL, or not without what is learned or drawn; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_neardup": r"""with recursive
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
x as (select doc_id, len(s) as n, unnest(s) as h from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * c >= 70 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join both_ways l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from s join c on doc_id = a"""
}
