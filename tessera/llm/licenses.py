"""Licence scan: template markup compiled into token automata.

A template is wording with ``<<var;...>>`` regions, which any words up to a number may replace,
and ``<<beginOptional>> .. <<endOptional>>`` regions, which may be missing.  It becomes an
automaton over words; a text has the licence if the automaton accepts a run of its words, that
is, if all mandatory wording stands there exactly.

Defined results: a null text is an empty text; no words, no labels, score 0; very long texts are
matched whole; repeated rows get equal results; of runs that begin at one word with one label the
longest is told, runs of different labels all are; an empty table gives an empty result; columns
besides the id and the text are left aside, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as K
from .store import ship

_W = r"[0-9a-z\x80-\U0010ffff]"
_SEP = r"[^0-9a-z\x80-\U0010ffff]"
_TOKEN = re.compile(_W + "+")
#: phrase, label, a word that the phrase can't do without
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
_BASE = [(re.compile(rf"(?<!{_W}){f'{_SEP}++'.join(p.split())}(?!{_W})"), label, max(p.split(), key=len), len(p.split())) for p, label in PHRASES]

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;0,2>> Redistributions of source code must retain the <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer<<beginOptional>>.<<endOptional>> <<var;0,2>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
_OWNER = "<<beginOptional>>the<<endOptional>> <<var;1,12>>"
_BSD_FIRST = "Redistributions of source code must retain the <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer."
_BSD_SECOND = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;0,2>> " + _BSD_FIRST + " <<var;0,2>> " + _BSD_SECOND
_BSD_END = (
    f"THIS SOFTWARE IS PROVIDED BY {_OWNER} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    f"IN NO EVENT SHALL {_OWNER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
#: label, template: whole licences, from the grant to the end of the disclaimer
FULL = [
    ("mit", _PERMISSION + ": The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;1,12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd-2-clause", _BSD_HEAD + " " + _BSD_END),
    ("bsd-3-clause", _BSD_HEAD + " <<var;0,2>> Neither the name of <<var;1,12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;1,8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;1,8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;0,1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;0,1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;0,1>> This notice may not be removed or altered from any source distribution"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
]
#: label, template: notices that name a licence, and (where they begin a whole licence of ``FULL``) beginnings that score less
TEMPLATES = [
    ("mit", "<<beginOptional>>This <<var;1,2>> is<<endOptional>> <<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>> under the MIT License"),
    ("mit", _PERMISSION),
    ("apache-2.0", "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0"),
    ("apache-2.0", "<<beginOptional>>Released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> Apache License, <<beginOptional>>Version<<endOptional>> 2.0"),
    ("gpl-3.0", "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3"),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-2.0", "under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("lgpl", "under the <<beginOptional>>terms of the<<endOptional>> GNU <<var;1,1>> General Public License"),
    ("agpl-3.0", "under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License"),
    ("cc-by-4.0", "<<beginOptional>>Licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "CC BY-NC-ND 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"),
    ("cc0-1.0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    ("bsd-3-clause", _BSD + " <<var;0,2>> Neither the name of <<var;1,12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", _BSD + ". <<beginOptional>><<var;0,2>> THIS SOFTWARE<<endOptional>> IS PROVIDED BY"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def tokens(text: str) -> list[str]:
    """The words of a text whose A-Z are lower-cased already."""
    return _TOKEN.findall(text)


def ascii_lower(text: str) -> str:
    return text if text.islower() else text.encode().translate(K.LOWER.tobytes()).decode()


class Automaton:
    """States are numbers; ``step[s]`` maps a word to next states, ``any_[s]`` takes every word, ``free[s]`` takes none."""

    def __init__(self, template: str) -> None:
        self.weight = 1.0
        self.step: list[dict[str, set[int]]] = [{}]
        self.any_: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.mandatory: list[str] = []
        at, depth, opened = 0, 0, []
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<beginOptional>>":
                opened.append(at)
                depth += 1
            elif part == "<<endOptional>>":
                self.free[opened.pop()].add(at)
                depth -= 1
            elif part.startswith("<<var;"):
                least, most = map(int, part[6:-2].split(","))
                first = []
                for i in range(most):
                    if i >= least:
                        first.append(at)
                    nxt = self._state()
                    self.any_[at].add(nxt)
                    at = nxt
                for s in first:
                    self.free[s].add(at)
            else:
                for word in tokens(ascii_lower(part)):
                    nxt = self._state()
                    self.step[at].setdefault(word, set()).add(nxt)
                    at = nxt
                    if not depth:
                        self.mandatory.append(word)
        self.end = at
        self.begin = self._closure({0})
        #: words that a match can begin with; templates don't begin with a variable
        self.first = {w for s in self.begin for w in self.step[s]}
        #: the rarest-looking word of all accepted texts: the longest
        self.anchor = max(self.mandatory, key=len)

    def _state(self) -> int:
        self.step.append({})
        self.any_.append(set())
        self.free.append(set())
        return len(self.step) - 1

    def _closure(self, states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def match(self, words: list[str], at: int) -> int | None:
        """The end of the shortest accepted run that begins at ``at``; None if there is none."""
        states = self.begin
        for i in range(at, len(words) + 1):
            if self.end in states:
                return i
            if i == len(words) or not states:
                return None
            w = words[i]
            states = self._closure({n for s in states for n in (self.step[s].get(w, ()) or ())} | {n for s in states for n in self.any_[s]})
        return None


_compiled: list[tuple[str, Automaton]] = []
#: Scores of a whole licence or a notice that names it, and of a part of a licence's text.
WHOLE, PART = 1.0, 0.75
_PARTS = ("Permission", "Redistribution", "This software", "This is free")


def automata() -> list[tuple[str, Automaton]]:
    if not _compiled:
        for label, t in [*FULL, *TEMPLATES]:
            a = Automaton(t)
            a.weight = PART if (label, t) not in FULL and t.startswith(_PARTS) else WHOLE
            _compiled.append((label, a))
    return _compiled


def scan_text(low: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """Of a lower-cased text: base places ``(word, label)`` and template runs ``(first word, end, label, score)``."""
    raw = [(m.start(), label) for rule, label, gate, _ in _BASE if gate in low for m in rule.finditer(low)]
    live = [(label, a) for label, a in automata() if a.anchor in low and all(w in low for w in a.mandatory)]
    if not raw and not live:
        return [], []
    found = [(m.start(), m.group()) for m in _TOKEN.finditer(low)]
    starts, words = [a for a, _ in found], [w for _, w in found]
    base = sorted((bisect_left(starts, a), label) for a, label in raw)
    runs = []
    if live:
        wanted = {w for _, a in live for w in a.first}
        for i, w in enumerate(words):
            if w in wanted:
                here = [(i, end, label, a.weight) for label, a in live if w in a.first and (end := a.match(words, i)) is not None]
                # a part that begins a longer run of the same licence says nothing of its own
                runs += [r for r in here if not any(o[2] == r[2] and o[1] > r[1] for o in here)]
    return base, runs


SCHEMA = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("templates", T.StringType())]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``keep`` and ``SCHEMA``.

    ``score`` is 1 if a whole licence or a notice that names one is accepted, 0.75 if only a part of a licence's
    text is, 0.5 if only base phrases stand there, else 0.
    ``templates`` lists accepted runs as ``label:first word:end``.
    """
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, t) for n, t in SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SCHEMA]
            for chunk in K.chunks(batch.column(text)):
                low = chunk.lowered()
                counts = K.words(low, K.ALNUM).counts.tolist()
                for i, n in enumerate(counts):
                    base, runs = scan_text(low.row_bytes(i).decode()) if n else ([], [])
                    labels = {x[1] for x in base}
                    row = (n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {x[2] for x in runs})), max(x[3] for x in runs) if runs else 0.5 if base else 0.0, ",".join(f"{x[2]}:{x[0]}:{x[1]}" for x in runs))
                    for c, v in zip(out, row):
                        c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(out, types))], names=[*keep, *(n for n, _ in SCHEMA)])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidied(run), schema)
