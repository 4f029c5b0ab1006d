"""The pipeline's stages against brute force, each on its own input."""

import brute
import fixture

import corpus_pipeline
from tessera.llm import decontam, mixing, pii, rules
from tessera.llm.store import read


def test_stages(spark, tmp_path):
    docs = fixture.rows()
    docs += [(500, "intro words " + fixture.BENCH[0][1] + " and more words after the passage ends here", "en", "s0"), (501, "please mail me.now@example.org or call +1 (555) 123-4567 at any hour of the day or night", "en", "s1")]
    folder = fixture.write(tmp_path / "p", docs)
    d = read(spark, folder, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-dedup", "decontamination", "PII masking", "mixing"]
    learned = rules.fit(d, read(spark, folder, "labels"))
    verdict = {r["doc_id"]: r["kept"] for r in rules.judge(d, learned, ["doc_id"]).collect()}
    out, before = d, [tuple(r) for r in d.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
        rows = [tuple(r) for r in out.collect()]
        if name == "quality rules":
            want = [r for r in before if verdict[r[0]]]
            assert all(not brute.quality(r[1])[5] for r in rows)
        elif name == "near-dedup":
            c = brute.components(before)
            want = [r for r in before if c[r[0]][1] == r[0]]
        elif name == "decontamination":
            words = lambda t: (t or "").lower().replace(".", " ").split()
            want = [r for r in before if not any(b and brute.edits(words(b), words(r[1])) <= decontam.allowed(len(words(b))) for _, b in fixture.BENCH)]
            assert len(want) < len(before)
        elif name == "PII masking":
            want = [(r[0], pii.mask_text(r[1]), *r[2:]) for r in before]
            assert not any("me.now@example.org" in (r[1] or "") for r in rows)
        else:
            total, sizes = brute.targets([(r[0], r[1], r[2], r[3]) for r in before])
            got = {s: 0 for s in sizes}
            for r in out.collect():
                got[r["source"]] += r["n_words"]
            assert all(abs(got[s] - total[s]) <= 0.5 for s in total)
            assert all(len(r["text"].split(" ")) == r["n_words"] <= mixing.BLOCK for r in out.collect())
            continue
        assert out.columns == d.columns and sorted(map(str, rows)) == sorted(map(str, want))
        before = rows


def test_run(spark, tmp_path):
    for k, docs in enumerate(([], fixture.rows())):
        out = corpus_pipeline.run(spark, fixture.write(tmp_path / str(k), docs))
        assert (out.count() > 0) == bool(docs)
