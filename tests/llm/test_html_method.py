"""The text-to-tag method by itself: against brute force, and on pages whose markup says nothing."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html
from tessera.llm.queries import QUERIES

PROSE = "A paragraph of the main text that goes on for quite a while, and then has some more words to say about it."


def slow(ratio):
    """Gaussian smoothing by its formula; the two means by trying every split of the sorted values that repeats itself."""
    smooth = []
    for i in range(len(ratio)):
        w = [(math.exp(-((j - i) ** 2) / 2), ratio[j]) for j in range(max(0, i - 2), min(len(ratio), i + 3))]
        smooth.append(round(sum(a * b for a, b in w) / sum(a for a, _ in w), 6))
    lo, hi = min(smooth), max(smooth)
    for _ in range(20):
        up = [x for x in smooth if x >= (lo + hi) / 2 - 1e-7]
        down = [x for x in smooth if x < (lo + hi) / 2 - 1e-7]
        lo, hi = (sum(down) / len(down) if down else lo), sum(up) / len(up)
    return [x >= (lo + hi) / 2 - 1e-7 and r > 0 for x, r in zip(smooth, ratio)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=40))
def test_content_is_the_upper_cluster(ratio):
    assert html.content(np.array(ratio, float)).tolist() == slow([float(x) for x in ratio])


def test_pages_whose_markup_says_nothing():
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(8))
    replies = "".join(f"<div><span><b>U{i}</b></span> <i>x</i> <u>ok</u></div>" for i in range(6))
    page = f"<body><div class=q1>{menu}</div><div class=q2><h2>Head</h2><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><ul><li>One</li><li>Two</li></ul><p>{PROSE}</p><p>End.</p></div><div class=q3>{replies}</div><div>Tiny note</div></body>"
    assert html.extract(page) == f"Head {PROSE} Short. {PROSE} One Two {PROSE} End."
    inner = page.replace("</div><div class=q3>", "<div class=q3>", 1).replace("<div>Tiny", "</div><div>Tiny", 1)
    assert html.extract(inner) == f"Head {PROSE} Short. {PROSE} One Two {PROSE} End."


def test_method_decides(monkeypatch):
    """With the clusters off, most pages come out otherwise."""
    rng = random.Random(3)
    pages = []
    for _ in range(40):
        menu = "".join(f"<li><a href=x>m{rng.random()}</a></li>" for _ in range(rng.randint(3, 9)))
        notes = "<div>" + "<p><b>by</b> <i>U</i> <u>at 9</u> said: I agree</p>" * rng.randint(6, 12) + "</div>"
        pages.append(f"<ul>{menu}</ul><div>" + "".join(f"<p>{PROSE * rng.randint(1, 4)}</p>" for _ in range(rng.randint(2, 6))) + notes + "</div>")
    mine = [html.extract(p) for p in pages]
    assert all(t.startswith("A paragraph") and t.endswith("it.") for t in mine)
    monkeypatch.setattr(html, "content", lambda r: np.ones(len(r), bool))
    assert sum(a != html.extract(p) for a, p in zip(mine, pages)) >= 30


def test_several_sections_and_short_ends():
    body = "".join(f"<div><p>Start {i}.</p><p>{PROSE}</p><p>{PROSE}</p></div>" for i in range(4))
    text = html.extract(f"<nav><a>x</a></nav><div>{body}<p>Bye.</p></div><footer>{PROSE}</footer>")
    assert text == " ".join(f"Start {i}. {PROSE} {PROSE}" for i in range(4)) + " Bye."


def test_awkward_pages(spark, tmp_path):
    n = 30_000
    for bad in ("<p><button>" + "<div>" * n, "<a " * n, "<!--" * n + ">", "<![CDATA[" * n, "</" * n, "&" * n, "<" * n + ">", "<div>" * n + "x" + "</div>" * n):
        began = time.time()
        html.extract(bad)
        assert time.time() - began < 8
    assert html.extract(f"<article><p>{PROSE}</p></article><p tail") == PROSE
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.string()), ("n_chars", pa.string()), ("kind", pa.string())])
    rows = [(1, "u", f"<p>{PROSE}</p>", "a", "b", "c"), (1, "u", f"<p>{PROSE}</p>", "a", "b", "c"), (None, None, None, None, None, None), (2, "u", "&amp;  &lt;b&gt;\n x", "a", "b", "c")]
    pq.write_table(pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema), tmp_path / "pages.parquet")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in QUERIES["op7_html"](spark, str(tmp_path)).collect())
    assert got == [("1", PROSE, len(PROSE)), ("1", PROSE, len(PROSE)), ("2", "& <b> x", 7), ("None", "", 0)]
    pq.write_table(pa.Table.from_pylist([], schema), tmp_path / "pages.parquet")
    assert QUERIES["op7_html"](spark, str(tmp_path)).count() == 0
