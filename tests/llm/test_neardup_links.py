"""Near-duplicates: recall near the threshold, buckets of unlinked pages, ids on several texts."""

import random

import brute
import fixture
import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm import kernel as K


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, node string, sa string")


def test_recall_at_the_threshold():
    """Pairs at 0.70 to 0.75 share two collections; the signatures alone decide who are candidates."""
    rng = np.random.default_rng(1)
    met = pairs = 0
    for _ in range(1500):
        n, share = 160, rng.uniform(0.70, 0.75)
        both = int(round(2 * n * share / (1 + share)))
        pool = rng.integers(1, 1 << 63, 2 * n - both, dtype=np.uint64)
        a, b = pool[:n], np.concatenate([pool[:both], pool[n:]])
        if 100 * both >= 70 * (2 * n - both):
            pairs += 1
            met += int((neardup.signature(a) == neardup.signature(b)).sum() >= 2)
    assert pairs > 1000 and met >= 0.999 * pairs


def test_unlinked_template_pages_are_not_compared(spark, monkeypatch):
    """Pages of 100 common and about 25 own words: 0.66 alike, so 600 of them have 179,700 pairs and no link."""
    rng = random.Random(3)
    common = " ".join(fixture.words(rng, "en", 100))
    rows = [(i, common + " " + " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(25 + i % 3))) for i in range(600)]
    seen, real = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, full: seen.append(pairs.count()) or real(pairs, full))
    got = neardup.link(docs(spark, rows)).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    assert seen[0] <= 100 * 600 and seen[1] <= 600


def test_bound_loses_no_link(spark, monkeypatch):
    """A bucket of pages just short of the threshold with their smallest, some linked with each other."""
    monkeypatch.setattr(neardup, "FEW", 2)
    rng = random.Random(5)
    common = " ".join(fixture.words(rng, "en", 100))
    own = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(rng.choice([12, 20, 26, 34]))) for _ in range(40)]
    rows = [(i, common + " " + own[i]) for i in range(40)] + [(40 + i, common + " " + fixture.near(rng, own[i], 1)) for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(docs(spark, rows)).collect()}
    assert got == brute.components(rows) and 1 < len({c for _, c in got.values()}) < 60


def test_ids_on_several_texts(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(fixture.words(rng, "en", 30)) for _ in range(3))
    d = docs(spark, [(3, a), (7, a), (7, b), (9, c), (9, c), (None, a), (None, a), (8, None), (8, ""), (5, b + " x")])
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.link(d).collect())
    assert got == sorted([("3", 3, True), ("7", 3, False), ("7", 5, False), ("9", 9, True), ("9", 9, True), ("None", None, True), ("None", None, True), ("8", 8, True), ("8", 8, True), ("5", 5, True)])
    left = neardup.dedup(d)
    assert left.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted([("3", a), ("9", c), ("None", a), ("None", a), ("8", ""), ("8", ""), ("5", b + " x")])
    e = docs(spark, [(3, a), (7, a), (7, b)])
    assert sorted((r["doc_id"], r["text"]) for r in neardup.dedup(e).collect()) == sorted([(3, a), (7, b)])
