"""What grows with the tables: whole answers, bounded files and tasks, what is shuffled."""

from pathlib import Path

import pytest
from micro import QUADS, RDF, ex
from pyspark.sql import functions as F

from tessera import Engine, TripleStore, VirtualGraph, queries
from tessera.operators import facets, vectors
from tessera.plans.graph import StoredGraph
from tessera.sources import store as stores
from tessera.sources import virtual

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@tables
def test_stored_answer_is_whole(spark, tmp_path):
    """matches beyond one page."""
    c = spark.range(10_010).select(F.col("id").alias("c_custkey"), F.format_string("C%d", "id").alias("c_name"), F.lit(3).cast("long").alias("c_nationkey"), F.lit("FURNITURE").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    c.write.parquet(str(tmp_path / "customer.parquet"))
    for t in ("nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    df = queries.QUERIES["stored_answer"](spark, str(tmp_path))
    assert df.count() == 7 * 10_010 and df.where("p = 'path'").count() == 10_010


def test_answers_are_those_of_query(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "s"))
    s.build_from(QUADS)
    virtual_graph = VirtualGraph(spark.createDataFrame(QUADS, "s string, p string, o string, g string"))
    for g in (s.graph(), virtual_graph):
        ask = {"filters": [{"p": RDF}], "paths": [ex("partOf")], "size": 100}
        want = Engine(g).query(ask)["results"]
        got = {r["id"]: r for r in Engine(g).plan(ask | {"size": 1}).answers().collect()}
        assert want.keys() == got.keys()
        for k, e in want.items():
            assert got[k]["properties"] == {p: v for p, v in e.items() if p not in ("id", "graph", "_paths")}
            assert got[k]["graph"] == e["graph"] and got[k]["paths"] == e.get("_paths", {})


def test_names_without_literals_leave_their_dictionary_alone(spark):
    """F4, F6."""
    q = spark.createDataFrame([(1, 2, 3, 4)], "s long, p long, o long, g long")
    iris = spark.createDataFrame([(1, "<s>"), (2, "<p>"), (4, "<g>")], "hash long, value string")
    bad = spark.range(1).select(F.lit(3).cast("long").alias("hash"), F.raise_error(F.concat(F.lit("read "), F.col("id").cast("string"))).cast("string").alias("value"))
    g = StoredGraph(q, iris, bad)
    assert [tuple(r) for r in g.decoded(q.select("s", "p", "g"), "spg").collect()] == [("<s>", "<p>", "<g>")]
    assert [tuple(r) for r in facets.facet(g, "graphs").collect()] == [(1, "<g>")]


def _shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_build_moves_texts_once(spark, tmp_path):
    """F3."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1500)), lambda i: F.sha2(F.concat_ws("/", "id", i), 256)), "")
    q = spark.range(40).select(F.format_string("<s%d>", "id").alias("s"), F.lit("<p>").alias("p"), F.concat(F.lit('"'), text, F.lit('"')).alias("o"), F.lit("").alias("g"))
    q.write.parquet(str(tmp_path / "q"))
    before = _shuffled(spark)
    TripleStore(spark, str(tmp_path / "s")).build_from(spark.read.parquet(str(tmp_path / "q")))
    assert _shuffled(spark) - before < 3.5 * 40 * 1500 * 64  # the texts, the postings and the terms of the index, once each


def test_literals_on_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "OFTEN", 2)
    rows = [(f"<s{i}>", "<p>", '"often"' if i % 2 else f'"x{i // 4} x{i // 4} y"', "") for i in range(40)]
    s = TripleStore(spark, str(tmp_path / "s"))
    s.build_from(rows)
    assert sorted(r["value"] for r in s.graph().literals().collect()) == sorted({r[2] for r in rows})
    p = {(r["term"], r["tf"], r["len"]) for r in s.index().postings.where("term in ('x1', 'y', 'often')").collect()}
    assert p == {("x1", 2, 3), ("y", 1, 3), ("often", 1, 1)}


@tables
@pytest.mark.parametrize("kind", ["trig", "gzip", "bzip2"])
def test_files_grow_in_number(spark, monkeypatch, tmp_path, kind):
    """F5, F7, F8."""
    monkeypatch.setattr(queries, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(queries, "FILE_BYTES", 20_000, raising=False)
    got = queries.QUERIES[f"read_{kind}"](spark, SF)
    want = virtual.quads(spark, SF, ["documents"]).select("s", "p", F.md5("o").alias("o"), "g" if kind == "trig" else F.lit("").alias("g"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    files = [f.stat().st_size for f in tmp_path.rglob("part-*")]
    assert len(files) > 5 and max(files) < sum(files) / 3


def test_documents_of_often_used_keys(spark, tmp_path, monkeypatch):
    """the rows of one object go to no single task."""
    rows = [("<hub>", "<p>", '"h"', ""), ("<hub>", "<p>", '"a"', "")] + [(f"<s{i}>", p, o, "") for i in range(30) for p, o in (("<t>", "<Type>"), ("<in>", "<hub>"), ("<at>", "<hub>"), ("<l>", '"f"'), ("<m>", f'"{i % 3}"'))]
    s = TripleStore(spark, str(tmp_path / "s"))
    s.build_from(rows)
    want = {"<hub>": '"a"\n"h"'} | {f"<s{i}>": f'"{i % 3}"\n"f"\t"a"\n"h"' for i in range(30)}
    seen = []
    for least in (2, 10_000):
        monkeypatch.setattr(vectors, "OFTEN", least, raising=False)
        for g in (s.graph(), VirtualGraph(spark.createDataFrame(rows, "s string, p string, o string, g string"))):
            df = vectors.subject_documents(g)
            assert {r["s"]: r["values"] for r in g.decoded(df, ["s"]).collect()} == want
            seen.append(vectors._often(g.quads().select("s", "o")).count())
    assert seen[0] > 0 and seen[2] == 0


@tables
def test_counts_of_subjects_need_no_distinct_quads(spark):
    """only short keys are made distinct."""
    g = virtual.graph(spark, SF, ["lineitem", "orders"])
    for df in (facets.total(g), facets.properties(g)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        aggregates = [x for x in plan.splitlines() if "Aggregate [" in x]
        assert not any("concat" in x or "g#" in x for x in aggregates), aggregates
        assert plan.count("Aggregate [") <= 2
