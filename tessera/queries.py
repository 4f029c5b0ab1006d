"""Queries over virtual graphs of the test tables, each with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, FtsConfig
from .functions.terms import hash_term, literal_datatype, literal_language, literal_value
from .operators import facets, pages, vectors
from .plans.engine import Engine, Plan
from .plans.graph import StoredGraph
from .plans.materialize import materialized, shared_dir
from .sources import ntriples, virtual
from .sources.store import TripleStore, dictionary
from .sources.virtual import B, prop

PLAIN = EngineConfig(fts=FtsConfig(stemmer="none", stopwords="none"))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TYPE, LABEL, PART_OF, NATION = (prop(x) for x in ("type", "label", "partOf", "nation"))
SEGMENT = prop("mktsegment")


def _q(kind: str, key: object) -> str:
    return f"<{B}{kind}/{key}>"


def _engine(spark: SparkSession, sf_dir: str, tables: list[str], config: EngineConfig = PLAIN) -> Engine:
    return Engine(virtual.graph(spark, sf_dir, tables), config)


def _with(tables: list[str], rest: str) -> str:
    return f"with q as ({virtual.sql(tables)}) {rest}" if not rest.startswith(",") else f"with q as ({virtual.sql(tables)}){rest}"


def _add(name: str, tables: list[str], opts: dict, shape: Callable[[Plan], DataFrame], sql: str | None, config: EngineConfig = PLAIN) -> None:
    QUERIES[name] = lambda spark, sf_dir: shape(_engine(spark, sf_dir, tables, config).plan(opts))
    if sql:
        ORACLE_SQL[name] = _with(tables, sql)


def _subjects(p: Plan) -> DataFrame:
    return p.matched.select("s")


def _where(p: str | None = None, o: str | list[str] | None = None) -> str:
    parts = [f"p = '{p}'"] if p else []
    if o:
        parts.append("o in (" + ", ".join(f"'{x}'" for x in ([o] if isinstance(o, str) else o)) + ")")
    return f"select distinct s from q where {' and '.join(parts)}"


# filters
FURNITURE, BUILDING = '"FURNITURE"', '"BUILDING"'
_add("filter_po", ["customer"], {"filters": [{"p": SEGMENT, "o": FURNITURE}]}, _subjects, _where(SEGMENT, FURNITURE))
_add("filter_p", ["nation", "customer", "region"], {"filters": [{"p": PART_OF}]}, _subjects, _where(PART_OF))
_add("filter_o", ["customer", "supplier", "nation"], {"filters": [{"o": _q("nation", 3)}]}, _subjects, _where(None, _q("nation", 3)))
_two = [_q("nation", 3), _q("nation", 7)]
_add("filter_multi_o", ["customer", "supplier"], {"filters": [{"p": NATION, "o": " ".join(_two)}]}, _subjects, _where(NATION, _two))
_ids = [_q("customer", 1), _q("customer", 17), _q("customer", "none")]
_add("filter_id", ["customer"], {"filters": [{"p": "id", "o": " ".join(_ids)}]}, _subjects, "select distinct s from q where s in (" + ", ".join(f"'{x}'" for x in _ids) + ")")
_graphs = [f"<{B}graph/src1>", f"<{B}graph/src2>"]
_add("filter_graph", ["documents"], {"filters": [{"p": TYPE, "o": f"<{B}Document>", "g": " ".join(_graphs)}]}, _subjects, _where(TYPE, f"<{B}Document>") + f" and g in ('{_graphs[0]}', '{_graphs[1]}')")
_abcd = [{"p": SEGMENT, "o": FURNITURE}, {"op": "or", "p": SEGMENT, "o": BUILDING}, {"op": "must", "p": NATION, "o": " ".join(_two)}, {"op": "not", "p": NATION, "o": _q("nation", 7)}]
_add("algebra_or_and_not", ["customer"], {"filters": _abcd}, _subjects, f"select s from ({_where(SEGMENT, FURNITURE)} union (({_where(SEGMENT, BUILDING)}) intersect ({_where(NATION, _two)}))) where s not in ({_where(NATION, _q('nation', 7))})")
_prec = [{"op": "not", "p": SEGMENT, "o": FURNITURE}, {"op": "not", "p": NATION, "o": _two[0]}, {"op": "should", "p": PART_OF, "o": _two[1]}, {"op": "and", "p": SEGMENT, "o": BUILDING}]
_add("algebra_precedence", ["customer"], {"filters": _prec}, _subjects, f"select s from ({_where(SEGMENT, FURNITURE)} union (({_where(PART_OF, _two[1])}) intersect ({_where(SEGMENT, BUILDING)}))) where s not in ({_where(NATION, _two[0])})")

_HOPS = ["region", "nation", "customer", "orders"]
for n in (1, 2, 3):
    joins = "".join(f" join q t{i} on t{i - 1}.s = t{i}.o" for i in range(1, n + 1))
    _add(f"hop{n}", _HOPS, {"filters": [{"p": f"{LABEL} {n}", "o": '"ASIA"'}]}, _subjects, f"""select distinct t{n}.s as s from q t0{joins} where t0.p = '{LABEL}' and t0.o = '"ASIA"'""")
_add("regex_prop", ["part"], {"filters": [{"p": f"regex {LABEL}", "o": '.*(red|blue) .*t.*'}]}, _subjects, f"select distinct s from q where p = '{LABEL}' and regexp_full_match(o, '.*(red|blue) .*t.*')")
_add("regex_hop1", ["nation", "region"], {"filters": [{"p": f"regex 1 {LABEL}", "o": '"A.*'}]}, _subjects, f"""select distinct t.s from q t join q d on t.o = d.s where d.p = '{LABEL}' and d.o like '"A%'""")


def _bm25(terms: list[str]) -> str:
    """CTEs ``hit(key, score)``; the tokens are those of the engine without stemmer and stop list."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(terms))
    every = " and ".join(f"tf{i} > 0" for i in range(len(terms)))
    figures = ", ".join(f"count(*) filter (where tf{i} > 0) as df{i}" for i in range(len(terms)))
    score = " + ".join(f"log10((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl))" for i in range(len(terms)))
    return (
        """, lit as (select distinct o as key from q where o like '"%'), tok as (select key, list_filter(string_split_regex(strip_accents(lower(key)), '[^a-z0-9]+'), lambda x: x <> '') as t from lit)"""
        f", cnt as (select key, len(t) as len, {tf} from tok), fig as (select count(*)::double as n, avg(len) as avgdl, {figures} from cnt), hit as (select key, {score} as score from cnt, fig where {every}) "
    )


def _scored(p: Plan) -> DataFrame:
    return p.matched.select("s", F.round("score", 6).alias("score"))


_add("fts_bm25", ["documents"], {"filters": [{"p": "fts", "o": "under license"}]}, _scored, _bm25(["under", "license"]) + "select s, round(max(score), 6) as score from q join hit on q.o = hit.key group by s")
_add("fts_prop", ["part", "nation"], {"filters": [{"p": f"fts {LABEL}", "o": "Red"}]}, _scored, _bm25(["red"]) + f"select s, round(max(score), 6) as score from q join hit on q.o = hit.key where p = '{LABEL}' group by s")
_add("fts_hop1", ["documents", "labels"], {"filters": [{"p": "fts 1", "o": "license"}]}, _scored, _bm25(["license"]) + "select t.s, round(max(score), 6) as score from q join hit on q.o = hit.key join q t on t.o = q.s group by t.s")
_fts_and = [{"p": "fts", "o": "under the"}, {"op": "must", "p": TYPE, "o": f"<{B}Document>", "g": _graphs[0]}]
_add("fts_and_graph", ["documents"], {"filters": _fts_and}, _scored, _bm25(["under", "the"]) + f"select s, round(max(score), 6) as score from q join hit on q.o = hit.key where s in (select s from q where p = '{TYPE}' and g = '{_graphs[0]}') group by s")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = virtual.graph(spark, sf_dir, ["embeddings"])
    seed = g.vectors().where(F.col("s") == _q("vec", 0)).first()["vec"]
    found = Engine(g, replace(PLAIN, semantic_distance=0.8), embed=lambda texts: [seed for _ in texts]).plan({"filters": [{"p": "semantic", "o": "vec 0"}]}).matched
    return found.select("s", F.round(F.when(F.col("score") == float("inf"), 0.0).otherwise(1 / F.col("score")), 6).alias("distance"))


QUERIES["semantic_topk"] = _nearest
ORACLE_SQL["semantic_topk"] = f"""with seed as (select embedding::double[] as v from embeddings where vec_id = 0), d as (select concat('<{B}vec/', cast(vec_id as string), '>') as s, 1 - list_cosine_similarity(embedding::double[], v) as d from embeddings, seed)
select s, round(case when d <= 1e-12 then 0.0 else d end, 6) as distance from d where d < 0.8"""

# aggregates
_ALL = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


def _direct(name: str, tables: list[str], call: Callable[..., DataFrame], sql: str, *args: object) -> None:
    QUERIES[name] = lambda spark, sf_dir: call(virtual.graph(spark, sf_dir, tables), *args)
    ORACLE_SQL[name] = _with(tables, sql)


_direct("total_subjects", [*_ALL, "documents", "events", "labels"], facets.total, "select count(distinct s) as total from q")
_direct("properties", _ALL, facets.properties, "select p as value, count(distinct s) as count from q group by p")
_direct("count_by_property", ["customer", "supplier"], facets.count_by_property, f"""select o as value, count(distinct s) as count from q where p = '{NATION}' and o not like '"%' group by o""", NATION)
_direct("spo", ["customer", "orders"], pages.spo, f"select s, p, o from q where p = '{prop('status')}' and o = '\"F\"'", None, prop("status"), '"F"')
_direct("sp", ["customer", "nation"], pages.sp, f"select s, o from q where s in ('{_q('customer', 1)}', '{_q('nation', 3)}')", [_q("customer", 1), _q("nation", 3)])
_direct("similar_items", ["part"], facets.similar, f"select s, count(*) as shared from q join (select p, o from q where s = '{_q('part', 1)}') d using (p, o) group by s having count(*) > 2", _q("part", 1), 2)
_FURN = {"filters": [{"p": SEGMENT, "o": FURNITURE}]}
_MATCH = f"s in ({_where(SEGMENT, FURNITURE)})"
_add("facet_properties", ["customer"], _FURN, lambda p: p.facet("properties"), f"select count(*) as count, p as value from q where {_MATCH} group by p")
_add("facet_prop_iri", ["customer"], _FURN, lambda p: p.facet(NATION), f"select count(*) as count, o as value from q where {_MATCH} and p = '{NATION}' group by o")
_add("facet_prop_literal", ["customer"], {"filters": [{"p": NATION, "o": _q("nation", 3)}]}, lambda p: p.facet(SEGMENT), f"select count(*) as count, o as value from q where s in ({_where(NATION, _q('nation', 3))}) and p = '{SEGMENT}' group by o")
_add("facet_graphs", ["documents", "labels"], {"filters": [{"p": TYPE, "o": f"<{B}Document>"}]}, lambda p: p.facet("graphs"), "select count(*) as count, g as value from q where g <> '' group by g")
_add("facet_global", [*_ALL, "documents"], {}, lambda p: p.facet("properties"), "select count(*) as count, p as value from q group by p")
_add("facet_global_graphs", ["documents", "customer"], {}, lambda p: p.facet("graphs"), "select count(*) as count, g as value from q where g <> '' group by g")

# order and pages


def _page(p: Plan) -> DataFrame:
    r = p.ranked()
    return r.select(F.col("pos").cast("long").alias("pos"), "s", *([F.md5("sort_label").alias("label")] if "sort_label" in r.columns else []))


def _ordered(label: str, keys: str, size: int, start: int = 0, where: str = "true", m: str = "select distinct s from q") -> str:
    return f", m as ({m}), lab as (select s, rank, x as sort_label from (select q.*, {label} from q) where {where} and o like '\"%'), best as (select s, sort_label from (select *, row_number() over (partition by s order by rank, sort_label) rn from lab) where rn = 1) select pos, s, md5(sort_label) as label from (select row_number() over (order by {keys}) as pos, s, sort_label from m left join best using (s)) where pos > {start} and pos <= {start + size}"


def _clean(*steps: str) -> str:
    e = """regexp_extract(o, '^"(.+)"', 1)"""
    for s in steps:
        e = s.format(e)
    return e


def _rank(*langs: str) -> str:
    return "case " + " ".join(f"when o like '%\"@{x}' then {i}" for i, x in enumerate(langs, 1)) + f" when o not like '%\"@%' then {len(langs) + 1} else {len(langs) + 2} end as rank"


_TRIM, _LOWER, _PUNCT, _SPACE = "trim({})", "lower({})", "regexp_replace({}, '^[^0-9A-Za-z]+', '')", "regexp_replace({}, '\\s+', ' ')"
_NULL_LAST = "sort_label is null, sort_label, s"
_docs = {"filters": [{"p": TYPE, "o": f"<{B}Document>"}]}
_add("order_label_lang", ["documents"], _docs | {"size": 50, "order": {"by": "property", "prop": prop("text"), "lang": ["fr", "de"]}}, _page, _ordered(f"{_clean(_TRIM, _LOWER)} as x, {_rank('fr', 'de')}", _NULL_LAST, 50, where=f"p = '{prop('text')}'"))
_add("order_label", ["nation", "region", "supplier"], {"size": 40, "start": 10, "order": {"by": "label", "dir": "desc"}}, _page, _ordered(f"{_clean(_TRIM, _LOWER)} as x, {_rank('de', 'en')}", "sort_label is null, sort_label desc, s", 40, 10, where=f"p = '{LABEL}'"))
_add("order_property", ["customer"], {"size": 100, "order": [{"by": "property", "prop": SEGMENT, "mode": "raw"}]}, _page, _ordered(f"{_clean(_TRIM)} as x, {_rank('de', 'en')}", _NULL_LAST, 100, where=f"p = '{SEGMENT}'"))
_add("order_object_label", ["customer", "nation"], {"filters": [{"p": TYPE, "o": f"<{B}Customer>"}], "size": 100, "order": {"by": "object_label", "via": NATION}}, _page, f", v as (select a.s, a.g, a.p as via, b.p, b.o from q a join q b on a.o = b.s where a.p = '{NATION}' and b.p = '{LABEL}')" + _ordered(f"{_clean(_TRIM, _LOWER)} as x, {_rank('de', 'en')}", _NULL_LAST, 100, m=f"select distinct s from q where p = '{TYPE}' and o = '<{B}Customer>'").replace("(select q.*,", "(select v.*,").replace(" from q) where true", " from v) where true"))
_add("order_natural", ["part"], {"size": 200, "order": {"by": "property", "prop": prop("size"), "natural": True, "dir": "desc"}}, _page, _ordered(f"{_clean(_TRIM, _LOWER)} as x, {_rank('de', 'en')}", "sort_label is null, try_cast(nullif(regexp_extract(sort_label, '^(\\d+)', 1), '') as integer) is null, try_cast(nullif(regexp_extract(sort_label, '^(\\d+)', 1), '') as integer) desc, sort_label desc, s", 200, where=f"p = '{prop('size')}'"))
_add("order_clean", ["documents"], _docs | {"size": 60, "order": {"by": "property", "prop": prop("text"), "clean": {"collapse_space": True, "strip_punct": True}}}, _page, _ordered(f"{_clean(_SPACE, _PUNCT, _TRIM, _LOWER)} as x, {_rank('de', 'en')}", _NULL_LAST, 60, where=f"p = '{prop('text')}'"))
_add("order_nulls_first", ["customer", "nation"], {"size": 60, "order": {"by": "property", "prop": SEGMENT, "nulls": "first"}}, _page, _ordered(f"{_clean(_TRIM, _LOWER)} as x, {_rank('de', 'en')}", "sort_label is not null, sort_label, s", 60, where=f"p = '{SEGMENT}'"))
_add("page_default", ["documents"], _docs | {"size": 20, "start": 5}, _page, "select pos, s from (select row_number() over (order by s) as pos, s from (select distinct s from q)) where pos > 5 and pos <= 25")
_add("page_score", ["documents"], {"filters": [{"p": "fts", "o": "license"}], "size": 10}, _page, _bm25(["license"]) + "select pos, s from (select row_number() over (order by score desc, s) as pos, s from (select s, max(score) as score from q join hit on q.o = hit.key group by s)) where pos <= 10")


def _rows(p: Plan) -> DataFrame:
    return p.entities().select(F.col("pos").cast("long").alias("pos"), "s", "p", "o")


_page_sql = f"select distinct pos, s, p, o from q join (select s, row_number() over (order by s) as pos from ({_where(SEGMENT, FURNITURE)})) using (s) where pos <= 50"
_add("entities", ["customer"], _FURN | {"size": 50}, _rows, _page_sql)
_add("only_properties", ["customer"], _FURN | {"size": 50, "only_properties": [LABEL, NATION]}, _rows, f"{_page_sql} and p in ('{LABEL}', '{NATION}')")
_add("exclude_properties", ["customer"], _FURN | {"size": 50, "exclude_properties": [LABEL, NATION]}, _rows, f"{_page_sql} and p not in ('{LABEL}', '{NATION}')")
_add(
    "paths", ["customer", "nation", "region"], _FURN | {"size": 200}, lambda p: p.paths(PART_OF).select("s", F.array_join("path", " ").alias("path")),
    f"""select c.s, a.o || ' ' || b.o as path from (select s from (select s, row_number() over (order by s) as pos from ({_where(SEGMENT, FURNITURE)})) where pos <= 200) c join q a on a.s = c.s and a.p = '{PART_OF}' join q b on b.s = a.o and b.p = '{PART_OF}'""",
)

# terms, sources, documents, mutation


def _literal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o")
    return virtual.quads(spark, sf_dir, ["documents", "part"]).select("s", "p", F.md5(literal_value(o)).alias("value"), literal_language(o).alias("language"), literal_datatype(o).alias("datatype"))


QUERIES["literal_parts"] = _literal_parts
_tail = "regexp_extract(o, '^\".*\"(.*)$', 1, 's')"
ORACLE_SQL["literal_parts"] = _with(["documents", "part"], f"""select s, p, case when o like '"%' then md5(regexp_extract(o, '^"(.*)"', 1, 's')) end as value, case when o like '"%' and {_tail} like '@%' then substr({_tail}, 2) end as language, case when o like '"%' and {_tail} like '^^%' then substr({_tail}, 3) end as datatype from q""")


def _parse_nt(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = virtual.quads(spark, sf_dir, ["documents", "labels"])
    escaped = F.regexp_replace("o", "é", r"\\u00E9")
    lines = q.select(F.concat_ws(" ", "s", "p", escaped, F.lit(".")).alias("value")).union(spark.createDataFrame([("# note",), ("<a> <b>",), ("",), ('"x" <p> <o> .',), ("<a>\t<b>\t<c> .",), ("<a> <b> <c> .\r",)], "value string"))
    return ntriples.parse_lines(lines).select("s", "p", F.md5("o").alias("o"))


QUERIES["parse_nt"] = _parse_nt
ORACLE_SQL["parse_nt"] = _with(["documents", "labels"], "select s, p, md5(o) as o from q")
QUERIES["dictionary_build"] = lambda spark, sf_dir: dictionary(virtual.quads(spark, sf_dir, ["customer", "nation"])).select(F.when(F.col("value").startswith('"'), "literal").otherwise("iri").alias("kind"), "value")
ORACLE_SQL["dictionary_build"] = _with(["customer", "nation"], """select distinct case when v like '"%' then 'literal' else 'iri' end as kind, v as value from (select s as v from q union all select p from q union all select o from q union all select g from q) where v <> ''""")
QUERIES["subject_documents"] = lambda spark, sf_dir: vectors.subject_documents(virtual.graph(spark, sf_dir, ["orders", "customer"])).select("s", F.md5("values").alias("values"))
ORACLE_SQL["subject_documents"] = _with(["orders", "customer"], """, own as (select s, string_agg(o, chr(10) order by o) as doc from (select distinct s, o from q where o like '"%') group by s), below as (select s, string_agg(doc, chr(10) order by doc) as doc from (select distinct q.s, q.o, own.doc from q join own on q.o = own.s) group by s) select s, md5(string_agg(doc, chr(9) order by doc)) as values from (select * from own union select * from below) group by s""")


def _store(spark: SparkSession, sf_dir: str, tables: list[str]) -> TripleStore:
    store = TripleStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", PLAIN)
    store.build_from(virtual.quads(spark, sf_dir, tables))
    return store


_NEW = [{"s": f"<{B}customer/new>", "p": SEGMENT, "o": FURNITURE}, {"s": _q("customer", 1), "p": SEGMENT, "o": FURNITURE}]


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, ["customer"])
    store.insert(_NEW)
    g = store.graph()
    return g.decoded(Engine(g, PLAIN).plan(_FURN).matched.select("s"), ["s"])


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, ["customer"])
    store.delete([{"s": _q("customer", 1), "p": NATION, "o": None}])
    g = store.graph()
    return g.decoded(Engine(g, PLAIN).plan({"filters": [{"p": NATION}]}).matched.select("s"), ["s"])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir, ["customer", "nation", "region"])
    return Engine(store.graph(), PLAIN, index=store.index()).plan({"filters": [{"p": "fts 1", "o": "NATION_3"}]}).facet(SEGMENT)


QUERIES |= {"insert_then_query": _inserted, "delete_then_query": _deleted, "stored_fts_facet": _stored}
ORACLE_SQL["insert_then_query"] = _with(["customer"], f"{_where(SEGMENT, FURNITURE)} union select '<{B}customer/new>' as s union select '{_q('customer', 1)}'")
ORACLE_SQL["delete_then_query"] = _with(["customer"], f"{_where(NATION)} and s <> '{_q('customer', 1)}'")
ORACLE_SQL["stored_fts_facet"] = _with(["customer", "nation", "region"], f"""select count(*) as count, o as value from q where p = '{SEGMENT}' and s in (select t.s from q t join q d on t.o = d.s where d.p = '{LABEL}' and d.o = '"NATION_3"') group by o""")
# the same questions to the stored graph: hashed, with dictionaries, its results decoded
_stores: dict[tuple, TripleStore] = {}


def _kept_store(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> TripleStore:
    """One store for each session and set of tables."""
    at = (spark.sparkContext.applicationId, sf_dir, tables)
    if at not in _stores:
        _stores[at] = _store(spark, sf_dir, [*tables])
    return _stores[at]


def _from_store(name: str, tables: list[str], shape: Callable[[StoredGraph, Engine], DataFrame], decode: list[str], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _kept_store(spark, sf_dir, tuple(tables))
        g = store.graph()
        return g.decoded(shape(g, Engine(g, PLAIN, index=store.index())), decode, iris=["parent", "root"])

    QUERIES[name] = query
    ORACLE_SQL[name] = _with(tables, sql)


def _s_of(opts: dict) -> Callable[[StoredGraph, Engine], DataFrame]:
    return lambda g, e: e.plan(opts).matched.select("s")


_GEO = ["customer", "nation", "region"]
_from_store("stored_filter_multi_o", _GEO, _s_of({"filters": [{"p": NATION, "o": " ".join(_two)}]}), ["s"], _where(NATION, _two))
_from_store("stored_filter_id", _GEO, _s_of({"filters": [{"p": "id", "o": " ".join(_ids)}]}), ["s"], "select distinct s from q where s in (" + ", ".join(f"'{x}'" for x in _ids) + ")")
_from_store("stored_algebra", _GEO, _s_of({"filters": _abcd}), ["s"], f"select s from ({_where(SEGMENT, FURNITURE)} union (({_where(SEGMENT, BUILDING)}) intersect ({_where(NATION, _two)}))) where s not in ({_where(NATION, _q('nation', 7))})")
_from_store("stored_hop2", _GEO, _s_of({"filters": [{"p": f"{LABEL} 2", "o": '"ASIA"'}]}), ["s"], f"""select distinct c.s from q r join q n on r.s = n.o join q c on n.s = c.o where r.p = '{LABEL}' and r.o = '"ASIA"'""")
_from_store("stored_regex", _GEO, _s_of({"filters": [{"p": f"regex {LABEL}", "o": '"NATION_1.*'}]}), ["s"], f"""select distinct s from q where p = '{LABEL}' and o like '"NATION_1%'""")
_from_store("stored_graph", ["documents"], _s_of({"filters": [{"p": TYPE, "o": f"<{B}Document>", "g": " ".join(_graphs)}]}), ["s"], _where(TYPE, f"<{B}Document>") + f" and g in ('{_graphs[0]}', '{_graphs[1]}')")
_from_store("stored_fts", ["documents"], lambda g, e: _scored(e.plan({"filters": [{"p": "fts", "o": "under license"}]})), ["s"], _bm25(["under", "license"]) + "select s, round(max(score), 6) as score from q join hit on q.o = hit.key group by s")
_from_store("stored_total", _GEO, lambda g, e: facets.total(g), [], "select count(distinct s) as total from q")
_from_store("stored_properties", _GEO, lambda g, e: facets.properties(g), [], "select p as value, count(distinct s) as count from q group by p")
_from_store("stored_count_by_property", _GEO, lambda g, e: facets.count_by_property(g, NATION), [], f"""select o as value, count(distinct s) as count from q where p = '{NATION}' and o not like '"%' group by o""")
_from_store("stored_facet_properties", _GEO, lambda g, e: e.plan(_FURN).facet("properties"), [], f"select count(*) as count, p as value from q where {_MATCH} group by p")
_from_store("stored_facet_iri", _GEO, lambda g, e: e.plan(_FURN).facet(NATION), [], f"select count(*) as count, o as value from q where {_MATCH} and p = '{NATION}' group by o")
_from_store("stored_facet_graphs", ["documents"], lambda g, e: e.plan({}).facet("graphs"), [], "select count(*) as count, g as value from q where g <> '' group by g")
_from_store("stored_spo", _GEO, lambda g, e: pages.spo(g, None, SEGMENT, FURNITURE), ["s", "p", "o"], f"select s, p, o from q where p = '{SEGMENT}' and o = '{FURNITURE}'")
_from_store("stored_sp", _GEO, lambda g, e: pages.sp(g, [_q("customer", 1), _q("nation", 3)]), ["s", "o"], f"select s, o from q where s in ('{_q('customer', 1)}', '{_q('nation', 3)}')")
_from_store("stored_similar", ["part"], lambda g, e: facets.similar(g, _q("part", 1), 2), ["s"], f"select s, count(*) as shared from q join (select p, o from q where s = '{_q('part', 1)}') d using (p, o) group by s having count(*) > 2")
_from_store("stored_order_label", _GEO, lambda g, e: e.plan({"filters": [{"p": LABEL}], "size": 30, "order": {"by": "label"}}).ranked().select(F.col("pos").cast("long").alias("pos"), "s"), ["s"], f", lab as (select s, min(lower(regexp_extract(o, '^\"(.+)\"', 1))) as x from q where p = '{LABEL}' group by s) select pos, s from (select row_number() over (order by x) as pos, s from lab) where pos <= 30")
_from_store("stored_entities", _GEO, lambda g, e: pages.entity_rows(g, e.plan(_FURN).matched.select("s"), e.plan(_FURN).spec).select("s", "p", "o"), ["s", "p", "o"], f"select distinct s, p, o from q where {_MATCH}")
_from_store("stored_only_properties", _GEO, lambda g, e: pages.entity_rows(g, e.plan(_FURN).matched.select("s"), e.plan(_FURN | {"only_properties": [LABEL]}).spec).select("s", "p", "o"), ["s", "p", "o"], f"select distinct s, p, o from q where {_MATCH} and p = '{LABEL}'")
_from_store("stored_paths", _GEO, lambda g, e: pages.paths(g, e.plan(_FURN).matched.select("s"), PART_OF).select("s", F.element_at("path", 1).alias("parent"), F.element_at("path", -1).alias("root")), ["s", "parent", "root"], f"select a.s, a.o as parent, b.o as root from q a join q b on a.o = b.s where a.p = '{PART_OF}' and b.p = '{PART_OF}' and a.{_MATCH}")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled answers of all matches, flat again."""
    store = _kept_store(spark, sf_dir, tuple(_GEO))
    found = materialized(Engine(store.graph(), PLAIN).plan(_FURN | {"paths": [PART_OF]}).answers(), "answers")
    rows = found.select(F.col("id").alias("s"), F.explode("properties").alias("p", "os")).select("s", "p", F.explode("os").alias("o"))
    ways = found.select(F.col("id").alias("s"), F.lit("path").alias("p"), F.array_join(F.element_at("paths", PART_OF), " ").alias("o"))
    return rows.union(ways.where(F.col("o").isNotNull()))


QUERIES["stored_answer"] = _answered
ORACLE_SQL["stored_answer"] = _with(_GEO, f"select distinct s, p, o from q where {_MATCH} union all select a.s, 'path', a.o || ' ' || b.o from q a join q b on a.o = b.s where a.p = '{PART_OF}' and b.p = '{PART_OF}' and a.{_MATCH}")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inserts and deletes say, and how many rows they leave."""
    store = _store(spark, sf_dir, ["nation"])
    mine = {"s": _q("nation", 3), "p": TYPE, "o": f"<{B}Nation>"}
    said = [
        ("exists", store.insert([mine])),
        ("other graph", store.insert([mine | {"g": f"<{B}graph/x>"}])),
        ("default after graph", store.insert([mine])),
        ("bad row refuses all", store.insert([{"s": "<n>", "p": "<p>", "o": '"1"'}, {"s": '"x"', "p": "<p>", "o": '"1"'}])),
        ("unknown delete refuses all", store.delete([mine, {"s": "<nobody>"}])),
        ("delete in default graph", store.delete([mine])),
    ]
    rows = store.graph().quads().where(F.col("s") == F.lit(hash_term(_q("nation", 3)))).count()
    return spark.createDataFrame([(k, "error" if "error" in v else "done", rows) for k, v in said], "step string, outcome string, left long")


QUERIES["mutation_rules"] = _refused
ORACLE_SQL["mutation_rules"] = _with(["nation"], f"select step, outcome, (select count(*) from q where s = '{_q('nation', 3)}') as left from (values ('exists', 'error'), ('other graph', 'done'), ('default after graph', 'error'), ('bad row refuses all', 'error'), ('unknown delete refuses all', 'error'), ('delete in default graph', 'done')) v(step, outcome)").replace(" as left ", ' as "left" ')


FILE_BYTES = 64 << 20


def _from_files(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Quads written to files of a kind, and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
        q = virtual.quads(spark, sf_dir, ["documents"])
        line = F.concat_ws(" ", "s", "p", F.regexp_replace("o", "é", r"\\u00E9"), F.lit(".")).alias("value")
        # files grow in number, not in size: a compressed one is read by one task
        files = max(3, -(-(q.select(F.sum(F.octet_length(line))).first()[0] or 0) // FILE_BYTES))
        if kind == "trig":  # a header for each piece of a graph, then its triples
            pieces = 4 * files
            heads = q.select("g").distinct().select("g", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)).cast("array<long>")).alias("piece"), F.lit(0).alias("n"), F.concat("g", F.lit(" {")).alias("value"))
            named = q.select("g", F.pmod(F.xxhash64("s"), F.lit(pieces)).cast("long").alias("piece"), F.lit(1).alias("n"), line).union(heads)
            named.repartition(files, "g", "piece").sortWithinPartitions("g", "piece", "n").select("value").write.text(f"{folder}/x.trig")
            return ntriples.read(spark, [f"{folder}/x.trig"], True).select("s", "p", F.md5("o").alias("o"), "g")
        q.select(line).repartition(files).write.option("compression", kind).text(folder)
        return ntriples.read(spark, [folder]).select("s", "p", F.md5("o").alias("o"), "g")

    return query


for _kind, _g in (("gzip", "''"), ("bzip2", "''"), ("trig", "g")):
    QUERIES[f"read_{_kind}"] = _from_files(_kind)
    ORACLE_SQL[f"read_{_kind}"] = _with(["documents"], f"select s, p, md5(o) as o, {_g} as g from q")

_add("random_sample", ["customer"], {"filters": [{"p": "id", "o": "random 25"}]}, _subjects, None)
QUERIES["raw_sql"] = lambda spark, sf_dir: _engine(spark, sf_dir, ["customer", "orders"]).raw(f"select a.o as segment, count(*) as n from triples a join triples b on b.o = a.s where a.p = '{SEGMENT}' and b.p = '{prop('customer')}' group by a.o")
ORACLE_SQL["raw_sql"] = _with(["customer", "orders"], f"select a.o as segment, count(*) as n from q a join q b on b.o = a.s where a.p = '{SEGMENT}' and b.p = '{prop('customer')}' group by a.o")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment, counted by nation."""
    return QUERIES["facet_prop_iri"](spark, sf_dir)
