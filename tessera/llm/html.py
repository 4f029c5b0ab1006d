"""Main text of web pages: events of the standard library's streaming parser, text-to-tag ratios.

The parser's events cut a page into lines, one a block, and note the element each stands in.  A
line's ratio is its text outside links over its tags; markup that says menu, header, footer, sidebar,
notice, advert, form or comment makes it 0.  Ratios are smoothed with a Gaussian along the page and
split into two clusters by a threshold; lines of the upper cluster are content, and nothing else
says what is.  The content selects the region: the container with the most content of its own, and
its ancestors while they add a fair share.  Inside the region, blocks without content go if they are
furniture, mostly links, or sections after the last content line; all other lines stay, however short.

Defined results: a null or empty page, or one without content, gives an empty text; very long
pages are parsed whole, in time linear in their length however deep the markup; broken markup is
read as far as it goes; of containers with equally much content the first counts, and a page whose
smoothed ratios are all equal is content wherever its ratio isn't 0; repeated rows, and rows that
repeat an id, get equal results each; an empty table gives an empty result; other columns are left
aside, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as K
from .store import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What isn't text for readers; no line comes from there.
_DROP = frozenset("button canvas head iframe math noscript object script select style svg template textarea title".split())
_FURNITURE = frozenset("aside dialog fieldset footer form menu nav".split())
_SECTION = frozenset("address article aside body center details dialog div fieldset footer form header html main menu nav section td".split())
_UNIT = _SECTION | frozenset("blockquote dl figure ol table ul".split())
_REGION = frozenset(["article", "main"])
_ROOT = frozenset(["html", "body", "article", "main"])
_ENDS_P = _BLOCK - {"br", "option"}
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adslot adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended recommendations "
    "footer footnav copyright share sharing social comment comments commentlist respond reply replies disqus discussion form search toolbar skip".split()
)
_OUTER_NAMES = frozenset(["header", "masthead", "topbar"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_OPENING = re.compile(r"<[a-zA-Z/!?]")
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
RADIUS, SIGMA = 2, 1.0
#: An ancestor is the region if it adds this share of content.
CLIMB = 0.15
#: Ratios this close to the threshold are on it.
_SAME = 1e-7


def _unwanted(tag: str, attrs: list, in_region: bool) -> bool:
    """Whether an element says of itself that it is page furniture."""
    if tag in _FURNITURE or (tag == "header" and not in_region):
        return True
    if not attrs:
        return False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value.lower())):
            return True
        if value and tag not in _ROOT:
            if name == "role" and value.lower() in _ROLES:
                return True
            if name in ("class", "id"):
                words = _SPLIT.split(value.lower())
                if any(w in _NAMES or (w in _OUTER_NAMES and not in_region) for w in words):
                    return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: ``(text, tags, characters in links, element, furniture)``; elements have numbers, and ``parent`` holds the tree."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.stack: list[tuple] = []  # tag, number, dropped, furniture, in a region, in an article's header
        self.places: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
        self.parent, self.kind, self.furniture = [0], [""], [False]
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            top = self.stack[-1] if self.stack else (None, 0, False, False)
            self.lines.append((text, self.tags, self.linked, top[1], top[3]))
        self.parts, self.tags, self.linked = [], 0, 0

    def _last(self, tags: Iterable[str]) -> int:
        """Where the innermost open element of these tags stands in the stack; -1 for none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def _pop(self, i: int) -> None:
        """Close the elements from ``stack[i]`` on."""
        if any(e[0] in _BLOCK for e in self.stack[i:]):
            self._flush()
        for e in self.stack[i:]:
            self.places[e[0]].pop()
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self._flush()
            if tag in _ENDS_P:
                self._close(("p",), ("button", "table", "td", "th"))
            if tag in _CLOSES:
                closed, scope = _CLOSES[tag]
                self._close(closed, scope)
        self.tags += 1
        if tag in _VOID:
            return
        _, above, dropped, furniture, region, header = self.stack[-1] if self.stack else (None, 0, False, False, False, False)
        if header and region and furniture and tag in _HEADING:
            furniture = False  # the headline in an article's own header
        header = header or (tag == "header" and region)
        said = _unwanted(tag, attrs, region) or (header and tag not in _HEADING)
        self.parent.append(above)
        self.kind.append(tag)
        self.furniture.append(said and not (tag == "header" and region))  # an article's own header may hold its headline
        furniture = furniture or said
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, len(self.parent) - 1, dropped or tag in _DROP, furniture, region or (tag in _REGION and not furniture), header))

    def _close(self, tags: tuple, scope: tuple) -> None:
        i = self._last(tags)
        if i > self._last(scope):
            self._pop(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        self.tags += 1
        i = self._last((tag,))
        # a stray end tag doesn't close an article around it
        if tag not in _VOID and i >= 0 and (tag in ("body", "html", "main") or i >= self._last(_REGION)):
            self._pop(i)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][2]):
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._flush()


def ratios(lines: list) -> np.ndarray:
    """Text to tags a line: characters outside links over tags; 0 for furniture."""
    return np.array([0.0 if dull else max(0, len(t) - linked) / max(1, tags) for t, tags, linked, _, dull in lines])


def content(ratio: np.ndarray) -> np.ndarray:
    """Which lines are content: the upper of two clusters of the smoothed ratios."""
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratio)), kernel)[RADIUS:-RADIUS]
    smooth = np.round(np.convolve(ratio, kernel)[RADIUS:-RADIUS] / weight, 6)
    lo, hi = smooth.min(), smooth.max()
    for _ in range(20):
        up = smooth >= (lo + hi) / 2 - _SAME
        new = (smooth[~up].mean() if not up.all() else lo, smooth[up].mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (smooth >= (lo + hi) / 2 - _SAME) & (ratio > 0)


def _up(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Of each element, the sum over its subtree; children have larger numbers."""
    total = own.tolist()
    for e in range(len(total) - 1, 0, -1):
        total[parent[e]] += total[e]
    return np.array(total)


def _region(p: _Lines, section: np.ndarray, sizes: np.ndarray, where: np.ndarray) -> int:
    """The element that holds the content."""
    own = np.bincount(section[where], sizes, len(section))
    held = _up(p.parent, np.bincount(where, sizes, len(section)))
    best = at = int(own.argmax())
    while at:
        at = int(section[p.parent[at]])
        extra = held[at] - held[best]
        if extra >= CLIMB * held[best] and (p.kind[best] not in _REGION or extra > held[best]):
            best = at
    return best


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    p = _Lines()
    # no tag ends beyond the last ">"; the parser would look for one from every "<" there
    cut = page.rfind(">") + 1
    p.feed(page[:cut])
    p.feed(_OPENING.split(page[cut:], maxsplit=1)[0])
    p.finish()
    lines = p.lines
    if not lines:
        return ""
    is_content = content(ratios(lines))
    if not is_content.any():
        return ""
    n, size, where = len(p.parent), np.array([len(x[0]) for x in lines]), np.array([x[3] for x in lines])
    inner = list(range(n))  # of each element, the container it stands in
    for e in range(1, n):
        inner[e] = e if p.kind[e] in _SECTION else inner[p.parent[e]]
    section = np.array(inner)
    region = _region(p, section, size * is_content, where)
    full, text, linked = (_up(p.parent, np.bincount(where, x, n)) for x in (size * is_content, size, np.array([x[2] for x in lines])))
    first = np.full(n, len(lines))
    np.minimum.at(first, where, np.arange(len(lines)))
    starts = first.tolist()
    for e in range(n - 1, 0, -1):
        starts[p.parent[e]] = min(starts[p.parent[e]], starts[e])
    # smoothing lets content spill over a border: a section is content if half of its text is
    main = 2 * full >= text
    last = int(np.flatnonzero(is_content & main[section[where]]).max(initial=-1))
    state = [False] * n
    state[region] = True
    for e in range(region + 1, n):
        if not state[p.parent[e]]:
            continue
        links = 2 * linked[e] > text[e]
        if p.furniture[e]:
            state[e] = bool(full[e])
        elif p.kind[e] in _SECTION:
            state[e] = bool(main[e]) or not (links or starts[e] > last)
        else:
            state[e] = bool(full[e]) or not (links and p.kind[e] in _UNIT)
    return " ".join(t for t, _, _, e, dull in lines if state[e] and not (dull and p.kind[e] == "header"))


def scan(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """A row per row of ``pages``: ``keep``, ``text``, ``n_chars``."""
    ship(pages.sparkSession)
    schema = T.StructType([*(pages.schema[k] for k in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*dict.fromkeys([*keep, html])).mapInArrow(K.tidied(run), schema)
