import asyncio
import gzip
import random

import pytest
from micro import A1, EX, INT42, QUADS, RDF, RDFS, ex, trig

from tessera import Engine, EngineConfig, FtsConfig, Service, TripleStore, VirtualGraph, split_literal, unescape
from tessera.functions.porter import stem
from tessera.functions.terms import hash_column, hash_term
from tessera.operators.facets import similar
from tessera.operators.vectors import hashing_embedder
from tessera.plans.spec import parse

PERSON = {"p": RDF, "o": ex("Person")}
G1 = ex("g1")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("nt")
    (d / "a.trig").write_text(trig(), newline="")
    return d


@pytest.fixture(scope="module")
def store(spark, folder):
    s = TripleStore(spark, str(folder / "store"))
    out = s.build([str(folder / "a.trig")])
    assert out["count"] == 24
    return s


@pytest.fixture(scope="module", params=["stored", "virtual"])
def engine(request, spark, store):
    if request.param == "stored":
        return Engine(store.graph(), index=store.index(), embed=hashing_embedder(64))
    return Engine(VirtualGraph(spark.createDataFrame(QUADS, "s string, p string, o string, g string").cache()))


def names(answer):
    return {k.removeprefix(f"<{EX}").removesuffix(">") for k in answer["results"]}


def ask(engine, *filters, **more):
    return engine.query({"filters": list(filters), **more})


def test_hashes(spark):
    terms = ["", "<a>", "é", "😀", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in terms], "t string").select(hash_column("t"))
    assert [r[0] for r in df.collect()] == [hash_term(t) for t in terms]
    assert hash_term("") == -1205034819632174695 and hash_term("<a>") == 7214930882065486087


def test_statistics(engine):
    assert engine.total() == 9
    p = {k.split("#")[-1].removeprefix(f"<{EX}").removesuffix(">"): v for k, v in engine.properties().items()}
    assert p == {"type": 8, "label": 5, "team": 2, "partOf": 2, "knows": 1, "address": 1, "street": 1, "age": 1, "note": 1}
    assert engine.count_by_property(RDF) == {ex("Person"): 5, ex("Team"): 2, ex("League"): 1}
    a = engine.query({"aggregates": ["properties", "graphs", ex("team")], "size": 0})["aggregates"]
    assert a["graphs"] == [(2, G1)] and set(a) == {"properties", "graphs"}
    assert dict((v, n) for n, v in a["properties"])[RDFS] == 6


def test_filters(engine):
    red = {"op": "not", "p": ex("team"), "o": ex("red")}
    assert names(ask(engine, PERSON, red)) == {"alice", "carol", "dave", "erin"}
    assert names(ask(engine, red)) == {"bob"}  # the first op doesn't matter
    got = ask(engine, {"p": ex("team"), "o": ex("red")}, {"op": "or", "p": RDF, "o": ex("Team")}, {"op": "and", "p": ex("partOf"), "o": ex("league")})
    assert names(got) == {"bob", "red", "blue"}
    assert names(ask(engine, {"o": ex("red")})) == {"bob"}
    assert names(ask(engine, {"p": ex("team"), "o": f"{ex('red')} {ex('blue')}"})) == {"bob", "carol"}
    assert names(ask(engine, PERSON | {"g": G1})) == {"erin"}
    assert names(ask(engine, {"p": ex("knows"), "g": G1})) == {"alice"}
    assert names(ask(engine, {"p": "id", "o": f"{ex('bob')} {ex('nobody')}"})) == {"bob"}
    assert names(ask(engine, {"p": "id", "o": ex("erin"), "g": G1})) == {"erin"}
    assert 1 <= ask(engine, {"p": "id", "o": "random 3"})["total"] <= 3


def test_hops(engine):
    red = '"Red swimmers"@en'
    assert names(ask(engine, {"p": f"{RDFS} 1", "o": red})) == {"bob"}
    assert names(ask(engine, {"p": f"{RDFS} 2", "o": red})) == {"alice"}
    assert names(ask(engine, {"p": f"{ex('partOf')} 1", "o": ex("league")})) == {"bob", "carol"}


def test_text(engine):
    assert names(ask(engine, {"p": "fts", "o": "FREESTYLE"})) == {A1}
    assert names(ask(engine, {"p": "fts 1", "o": "freestyle"})) == {"alice"}
    assert names(ask(engine, {"p": f"fts {ex('street')}", "o": "roads"})) == {A1}
    assert names(ask(engine, {"p": "fts", "o": "integer"})) == {"dave"}
    assert names(ask(engine, {"p": "fts", "o": "cafe"})) == {"dave"}
    assert names(ask(engine, {"p": "fts", "o": "freestyle integer"})) == set()
    assert names(ask(engine, {"p": "regex", "o": ".*lic.*"})) == {"alice"}
    assert names(ask(engine, {"p": "regex", "o": "lic"})) == set()
    assert names(ask(engine, {"p": f"regex 1 {RDFS}", "o": ".*swim.*"})) == {"bob"}


def test_facets(engine):
    a = ask(engine, PERSON, size=0, aggregates=["properties", "graphs", ex("team"), ex("knows")])
    assert a["total"] == 5 and a["results"] == {}
    a = a["aggregates"]
    assert sorted(a[ex("team")]) == [(1, ex("blue")), (1, ex("red"))] and a[ex("knows")] == [(2, ex("bob"))] and a["graphs"] == [(2, G1)]
    assert sorted(n for n, _ in a["properties"]) == [1, 1, 1, 2, 2, 4, 5]


def test_order(engine):
    def order(*filters, **rule):
        p = engine.plan({"filters": list(filters), "order": rule})
        d = engine.graph.decoded(p.ranked().select("pos", "s", "sort_label"), ["s"])
        return [(r["s"].split("/")[-1][:-1], r["sort_label"]) for r in d.orderBy("pos").collect()]

    got = order(PERSON, by="label")
    assert [x for _, x in got] == ["2 carol", "alicia", "bob", None, None]
    if engine.graph.version != "0":
        assert [n for n, _ in got][3:] == sorted(["dave", "erin"], key=lambda n: hash_term(ex(n)) % (1 << 64))
    league = {"op": "or", "p": RDF, "o": ex("League")}
    assert [x for _, x in order(PERSON, league, by="label")][:2] == ["10 league", "2 carol"]
    assert [x for _, x in order(PERSON, league, by="label", natural=True)][:2] == ["2 carol", "10 league"]
    assert [x for _, x in order(PERSON, by="label", dir="desc", nulls="first")][2:] == ["bob", "alicia", "2 carol"]
    assert [x for _, x in order(PERSON, by="label", lang=["en"], mode="raw")][:3] == ["2 Carol", "Alice", "bob"]
    assert order(PERSON, by="object_label", via=ex("team"))[0] == ("bob", "red swimmers")
    assert order(PERSON, by="property", prop=ex("note"))[0] == ("dave", "café")
    assert [x for _, x in order(PERSON, by="label", clean={"strip_punct": True})][0] == "2 carol"


def test_pages(engine):
    a = ask(engine, PERSON, only_properties=[RDFS])
    assert a["total"] == 5 and names(a) == {"alice", "bob", "carol"}
    a = ask(engine, PERSON, exclude_properties=[RDFS, RDF])
    assert a["results"][ex("alice")][ex("knows")] == [ex("bob")] and a["results"][ex("alice")]["graph"] == [G1] and RDF not in a["results"][ex("alice")]
    seen = [list(ask(engine, PERSON, size=2, start=i)["results"]) for i in (0, 2, 4)]
    assert len({x for page in seen for x in page}) == 5
    paths = ask(engine, {"p": RDF, "o": f"{ex('Team')} {ex('League')}"}, paths=[ex("partOf")])["results"]
    assert {k: v["_paths"][ex("partOf")] for k, v in paths.items()} == {ex("red"): [ex("league")], ex("blue"): [ex("league")], ex("league"): []}
    assert len(engine.spo(ex("alice"))) == 6 and len(engine.spo(o=INT42)) == 1
    assert engine.sp([ex("alice")], ex("knows")) == {ex("alice"): [ex("bob")] * 2}
    with pytest.raises(TypeError):
        engine.sp(ex("alice"))
    with pytest.raises(TypeError):
        engine.spo(3)
    assert engine.raw("select count(*) as n from triples").first()["n"] == 24


def test_cycles_end(spark):
    q = [("<a>", "<p>", "<b>", ""), ("<b>", "<p>", "<a>", ""), ("<c>", "<p>", "<d>", ""), ("<c>", "<p>", "<a>", ""), ("<d>", "<t>", "<x>", "")]
    e = Engine(VirtualGraph(spark.createDataFrame(q, "s string, p string, o string, g string")))
    got = {r["s"]: r["path"] for r in e.plan({}).paths("<p>").collect()}
    assert got == {"<c>": ["<d>"], "<d>": []}


def test_long_paths_are_whole(spark):
    q = [(f"<n{i}>", "<p>", f"<n{i + 1}>", "") for i in range(70)] + [("<n70>", "<t>", "<x>", "")]
    e = Engine(VirtualGraph(spark.createDataFrame(q, "s string, p string, o string, g string")))
    got = {r["s"]: r["path"] for r in e.plan({}).paths("<p>").collect()}
    assert got == {f"<n{i}>": [f"<n{k}>" for k in range(i + 1, 71)] for i in range(71)}


def test_similar(spark):
    q = [("<a>", f"<p{i}>", "<o>", "") for i in range(4)] + [("<b>", f"<p{i}>", "<o>", "") for i in range(3)] + [("<c>", "<p0>", "<o>", "")]
    g = VirtualGraph(spark.createDataFrame(q, "s string, p string, o string, g string"))
    assert {(r["s"], r["shared"]) for r in similar(g, "<a>", 1).collect()} == {("<a>", 4), ("<b>", 3)}


def test_requests():
    for bad in ({"filters": [{"p": "foo"}]}, {"filters": [{"o": "x", "op": "xor"}]}, {"order": {"by": "moon"}}, {"order": {"by": "property"}}, {"order": {"by": "object_label"}}, {"filters": [{}]}):
        with pytest.raises(ValueError):
            parse(bad)
    spec = parse({"size": "x", "start": None, "order": [[{"by": "label"}]], "filters": [{"p": "<p> 2 <q>", "o": " <a> <b> "}]})
    assert (spec.size, spec.start, spec.order.by) == (999, 0, "label")
    assert spec.filters[0].hops == 2 and spec.filters[0].objects == ("<a>", "<b>")
    assert parse({"filters": [{"p": "id", "o": "random many"}]}).filters[0].count == 1


def test_algebra_against_sets(spark):
    rng = random.Random(3)
    rows = [(f"<s{rng.randrange(12)}>", "<p>", f"<o{rng.randrange(5)}>", "") for _ in range(40)]
    e = Engine(VirtualGraph(spark.createDataFrame(rows, "s string, p string, o string, g string").cache()))
    of = {f"<o{i}>": {s for s, _, o, _ in rows if o == f"<o{i}>"} for i in range(5)}
    for _ in range(6):
        fs = [{"op": rng.choice(["or", "and", "not"]), "p": "<p>", "o": f"<o{rng.randrange(5)}>"} for _ in range(4)]
        terms, nots = [], set()
        for i, f in enumerate(fs):
            if i and f["op"] == "not":
                nots |= of[f["o"]]
            elif i and f["op"] == "and":
                terms[-1] = terms[-1] & of[f["o"]]
            else:
                terms.append(set(of[f["o"]]))
        assert {r["s"] for r in e.plan({"filters": fs}).matched.collect()} == set.union(*terms) - nots


def test_terms():
    assert split_literal(INT42) == ("42", None, "<http://www.w3.org/2001/XMLSchema#integer>")
    assert split_literal('"a"@en') == ("a", "en", None) and split_literal("<a>") == (None, None, None) and split_literal('"') == (None, None, None)
    assert unescape("\\u00E9\\U0001F600") == "é😀" and unescape("\\uD800") is None
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "relational", "sky", "roads", "adjustable", "probate")] == ["caress", "poni", "hop", "relat", "sky", "road", "adjust", "probat"]


def test_sources(spark, folder, tmp_path):
    from tessera.sources import dump, ntriples

    with gzip.open(tmp_path / "b.nt.gz", "wt") as f:
        f.write("<a> <b> \"x\\u0041\"@en .\n<a> <b> \"y .\" .\n<a> <b> <c>")
    assert {r["o"] for r in ntriples.read(spark, [str(tmp_path / "b.nt.gz")]).collect()} == {'"xA"@en', '"y ."'}
    with pytest.raises(TypeError):
        ntriples.read(spark, "x")
    dump.hash_dump(spark, [str(tmp_path / "b.nt.gz")], str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    assert dump.term_map(spark, [str(tmp_path / "b.nt.gz")], str(tmp_path / "m")).count() == 4
    assert dump.term_map(spark, [str(tmp_path / "b.nt.gz")], str(tmp_path / "m2"), str(tmp_path / "m")).count() == 0


def test_writes(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "w"), EngineConfig(fts=FtsConfig(stemmer="none")))
    assert s.build([]) == {"duration": 0, "error": "no input"}
    s.build_from(QUADS)
    assert "error" in s.build_from(QUADS)
    assert "error" in s.insert([{"s": ex("erin"), "p": RDF, "o": ex("Person")}])  # it exists in a graph
    assert "error" in s.insert([{"s": "erin", "p": RDF, "o": ex("Person")}]) and "error" in s.insert([{"s": None, "p": RDF, "o": "x"}])
    new = {"s": ex("zoe"), "p": RDFS, "o": '"Zoe"'}
    assert s.insert([new, new]) == {"triples_inserted": 1, "iris_inserted": 1, "literals_inserted": 1}
    assert s.stale()
    e = lambda: Engine(s.graph(), s.config, index=s.index())
    assert e().query({"filters": [{"p": RDFS, "o": '"Zoe"'}]})["total"] == 1 and e().query({"filters": [{"p": "fts", "o": "zoe"}]})["total"] == 0
    s.reindex()
    assert e().query({"filters": [{"p": "fts", "o": "zoe"}]})["total"] == 1
    assert s.delete([{"s": ex("alice"), "p": ex("knows"), "o": None, "g": ""}]) == {"triples_deleted": 1, "rows_deleted": 1}
    assert e().sp([ex("alice")], ex("knows")) == {ex("alice"): [ex("bob")]}
    assert "error" in s.delete([{"s": ex("nobody")}])
    s.insert([{"s": ex("alice"), "p": ex("knows"), "o": ex("bob")}])  # in g1, so it's refused
    assert len(e().spo(ex("alice"), ex("knows"))) == 1
    before = sorted(e().spo())
    s.compact()
    assert sorted(e().spo()) == before and not s.stale()
    assert s.build_vectors(hashing_embedder(32))["count"] > 0
    q = Engine(s.graph(), s.config, embed=hashing_embedder(32)).query({"filters": [{"p": "semantic", "o": '"10 Freestyle Road"'}]})
    assert A1 in q["results"]


def test_streaming(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.nt").write_text("<a> <b> <c> .\n<a> <b> \"d\" .\n")
    s = TripleStore(spark, str(tmp_path / "st"))
    for name in ("1.nt", "2.nt"):
        if name == "2.nt":
            (src / name).write_text("<a> <b> <c> .\n<x> <b> <c> .\n")
        q = ingest(spark, str(src), s, str(tmp_path / "cp"), once=True)
        q.awaitTermination()
    assert sorted(Engine(s.graph()).spo()) == [("<a>", "<b>", '"d"'), ("<a>", "<b>", "<c>"), ("<x>", "<b>", "<c>")]


def test_service(spark, tmp_path):
    s = TripleStore(spark, str(tmp_path / "sv"))
    s.build_from(QUADS)
    service = Service(s, 2)

    async def go():
        ask = {"filters": [PERSON], "size": 0}
        one, two = await asyncio.gather(service.query_async(ask), service.query_async(ask | {"use_cache": False}))
        assert one["total"] == two["total"] == 5
        assert (await service.query_async(ask))["cached"]
        await service.insert_async([{"s": ex("zoe"), "p": RDF, "o": ex("Person")}])
        assert (await service.query_async(ask))["total"] == 6
        await service.delete_async([{"s": ex("zoe"), "p": RDF, "o": ex("Person")}])
        assert "error" in await service.query_async({"filters": [{"p": "foo"}]})
        with pytest.raises(Exception, match="too long"):
            await service.query_async(ask | {"size": 1}, timeout=1e-6)

    asyncio.run(go())
    service.close()
