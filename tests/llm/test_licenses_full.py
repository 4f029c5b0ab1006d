"""Whole licences against their parts."""

import re

from tessera.llm import licenses


def text_of(template):
    """The shortest text that a template accepts."""
    t = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", template)
    t = re.sub(r"<<var;(\\d+),\\d+>>".replace("\\\\", "\\"), lambda m: " name" * int(m[1]), t)
    return licenses.ascii_lower(t)


def test_whole_licences_are_accepted_whole():
    for label, template in licenses.FULL:
        text = text_of(template)
        runs = licenses.scan_text(text)[1]
        assert (0, len(licenses.tokens(text)), label, 1.0) in runs, label
        words = licenses.tokens(text)
        for k in (len(words) // 3, len(words) - 1):  # any other word of the mandatory wording breaks it
            broken = " ".join([*words[:k], "otherwise" if words[k] != "otherwise" else "x", *words[k + 1 :]])
            assert not any(r[2] == label and r[3] == 1.0 and r[1] == len(words) for r in licenses.scan_text(broken)[1]), (label, k)


def test_a_part_with_other_terms_is_no_whole_licence():
    text = licenses.ascii_lower(text_of(licenses._PERMISSION) + ": you must pay the author and never redistribute. no other terms.")
    assert [r[3] for r in licenses.scan_text(text)[1]] == [licenses.PART]
