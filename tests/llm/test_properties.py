"""Random texts against the direct regular expressions."""

import re

import brute
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernel, licenses, neardup, pii, rules, secrets
from tessera.llm import spans as S


def digest(found, module, kinds):
    return tuple(sum(s[0] == k for s in found) for k in kinds) + (S.digest(S.joined(found, module.ORDER)),)


@settings(max_examples=600, deadline=None)
@given(st.text("a@._%+- 1\n,é", max_size=40) | st.text("0123456789.-+ ()", max_size=60))
def test_pii(t):
    assert digest(pii.base(t), pii, pii.BASE) == brute.pii(t)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "toKen", "api_key", "apikey", "secret", "ſecret", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "deadbeef", "g", "é", "-", "/"]), max_size=14).map("".join))
def test_secrets(t):
    assert digest(secrets.base(t), secrets, secrets.BASE) == brute.secrets(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["cc", "by", "CC BY", "general", "public", "license", "all rights reserved", " ", "-", "\n", "é", "x", "1", "\x00"]), max_size=14).map("".join))
def test_licenses(t):
    base, _ = licenses.scan_text(brute.low(t))
    want = brute.licences(t)
    at = [k for k, _ in base]
    assert (len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base}))) == want[1:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab \n\té#", max_size=30) | st.none(), max_size=6))
def test_statistics_and_sets(texts):
    column = pa.array(texts, pa.string())
    got = [r for c in kernel.chunks(column, 16) for r in zip(*(x.tolist() for x in rules.stats(c)[:5]))]
    assert got == [brute.quality(t)[:5] for t in texts]
    sets = [len(s) for c in kernel.chunks(column, 16) for s in neardup.shingle_sets(c.lowered())]
    assert sets == [len(brute.shingles(t)) for t in texts]


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for t in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "password" + " " * 200_000, "f" * 300_000, "eyJ" * 100_000, "-----BEGIN " + "A " * 100_000):
        pii.base(t), pii.extra(t), secrets.base(t), secrets.extra(t), licenses.scan_text(t)
    assert time.time() - began < 60


def test_license_templates_accept_their_wording():
    for label, a in licenses.automata():
        assert a.mandatory and a.first
    text = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    assert [x[2] for x in licenses.scan_text(text)[1]] == ["mit"]
    assert licenses.scan_text(text.replace("hereby", "here"))[1] == []
    assert [x[2] for x in licenses.scan_text("redistributed under the terms of the gnu lesser general public license")[1]] == ["lgpl"]
    assert re.match("gpl", licenses.scan_text("under the gnu general public license version 3")[1][0][2])
