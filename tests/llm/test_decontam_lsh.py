"""The CGK walks and bit samples by themselves: recall, selectivity, awkward ids."""

import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontam
from tessera.llm import kernel as K


def words(rng, n, kinds=4000):
    """Words by a Zipf-like law, so that frequent ones meet by chance."""
    return [f"w{int(kinds ** rng.random())}" for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        p, kind = rng.randrange(len(w)), rng.choice("sid")
        if kind == "s":
            w[p] = words(rng, 1)[0]
        elif kind == "i":
            w.insert(p, words(rng, 1)[0])
        elif len(w) > 1:
            del w[p]
    return w


def found(items, texts):
    return {(m[0], m[1]) for c in decontam.folded(pa.array([" ".join(t) for t in texts])) for m in decontam.search(items, c)}


@pytest.mark.parametrize("n", [3, 4, 5, 8, 9, 13, 16, 17, 30, 64, 200])
def test_recall_at_the_allowed_edits(n):
    rng = random.Random(n)
    bench = [words(rng, n) for _ in range(100)]
    items = decontam.compile_items(list(range(100)), [" ".join(b) for b in bench])
    texts = [words(rng, 12) + edited(rng, b, decontam.allowed(n)) + words(rng, 12) for b in bench for _ in range(2)]
    got = found(items, texts)
    assert sum((k, k // 2) in got for k in range(200)) >= 198
    assert all(brute.edits(bench[i], texts[k]) <= decontam.allowed(n) for k, i in got)


def test_unrelated_windows_are_rejected():
    rng = random.Random(1)
    bench = [words(rng, rng.randint(8, 60)) for _ in range(100)]
    items = decontam.compile_items(list(range(100)), [" ".join(b) for b in bench])
    texts = [" ".join(words(rng, 2000)) for _ in range(20)]
    (chunk,) = decontam.folded(pa.array(texts))
    w = K.words(chunk, K.ALNUM)
    assert len(decontam.candidates(items, w.hashes(), w)) < 0.001 * 100 * 40_000 * 0.01  # of 4,000,000 places and items


def test_items_with_one_stem():
    """400 items begin alike and a document holds the beginning 400 times."""
    rng = random.Random(2)
    stem = words(rng, 8)
    bench = [stem + words(rng, 24) for _ in range(400)]
    items = decontam.compile_items(list(range(400)), [" ".join(b) for b in bench])
    text = [w for _ in range(400) for w in stem + words(rng, 24)] + bench[7]
    began = time.time()
    assert found(items, [text]) == {(0, 7)}
    assert time.time() - began < 20


def test_walks_of_equal_runs_are_equal_wherever_they_stand():
    rng = np.random.default_rng(3)
    run = rng.integers(1, 1 << 60, 30).astype(np.uint64)
    both = np.concatenate([run, rng.integers(1, 1 << 60, 7).astype(np.uint64), run])
    ids = np.append(both.astype(np.int64), 0)
    for walk in range(4):
        steps = [x.tolist() for _, x in decontam.embed(ids, decontam._bits(both, walk), np.array([0, 37]), 25)]
        assert all(a == b for a, b in steps)


@pytest.mark.parametrize("kind, ids", [("string", ["", "b", None]), ("decimal(9,2)", [1, 2, None]), ("date", ["2020-01-01", "2020-01-02", None]), ("smallint", [0, 1, None])])
def test_ids_of_any_type(spark, kind, ids):
    docs = spark.createDataFrame([(i, "a whole item of words", "x") for i in ids], "doc_id string, text string, item_id string").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "item_id", "text as _key")
    bench = spark.createDataFrame([(i, t) for i, t in zip(ids, ["a whole item of words", "another one here", "item of"])], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text", "text as edits")
    got = decontam.scan(docs, bench).collect()
    assert len(got) == 6 and {r["item_words"] for r in got} == {5, 2}
    assert decontam.clean(docs, bench).columns == docs.columns and decontam.clean(docs, bench).count() == 0
