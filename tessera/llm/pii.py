"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

A span of the base list always stands, with its score beside it; others need a score of ``THRESHOLD``.

Defined results: a null or empty text has no spans; a very long text is scanned whole in
time linear in its length; repeated rows each get their own result; spans of several kinds may overlap
and all stand, in order of start, then kind as listed; a mask takes the longest of those that begin
together; an empty table gives an empty result; columns beside the text are passed through, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernel as K
from . import spans as S
from .store import ship

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "ssn"]
ORDER = {k: i for i, k in enumerate(KINDS)}
#: A span that the base list doesn't have needs this score.
THRESHOLD = 0.5
CONTEXT = 48

_LOCAL = r"[A-Za-z0-9._%+-]"
_REST = r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
# A run of local-part characters can only match from its first character, or from the end of the match before.
_EMAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}{_REST}")
_EMAIL_HERE = re.compile(_LOCAL + _REST)
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_GROUP = re.compile(r"[0-9]+")
_SHAPES = [[4, 4, 4, 4], [4, 6, 5], [16], [15]]
_ISSUER = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
#: IBAN lengths of the public registry.
_IBAN_LENGTH = dict(
    x.split(":")
    for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split()
)
_WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|from)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|t[eé]l[eé]fono?)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|social-security)\b"),
}
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "local": 0.3, "iban": 0.8, "ssn": 0.3}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    m = _EMAIL.search(text)
    while m:
        yield "email", m.start(), m.end()
        m = _EMAIL_HERE.match(text, m.end()) or _EMAIL.search(text, m.end())


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base(text: str) -> list[tuple[str, int, int]]:
    """The base spans: leftmost non-overlapping matches a kind, less those that fail the kind's check."""
    found = [*_emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _cards_within(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Cards in a run of digits that isn't one as a whole: groups as issuers print them, with their prefix and a right check digit."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, a, b)]
    found, i = [], 0
    while i < len(groups):
        for shape in _SHAPES:
            part = groups[i : i + len(shape)]
            if [y - x for x, y in part] == shape and _ISSUER.match(d := _digits(text[part[0][0] : part[-1][1]])) and luhn(d):
                found.append(("card", part[0][0], part[-1][1]))
                i += len(shape) - 1
                break
        i += 1
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the span's kind and shape, raised by a context word nearby."""
    near = text[max(0, start - CONTEXT) : start] + " \0 " + text[end : end + CONTEXT]
    prior = _PRIOR["local" if kind == "phone" and text[start] != "+" else kind]
    return min(1.0, prior + 0.3 * bool(_WORDS[kind].search(near)))


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Spans beyond the base list: bank accounts with a right checksum, cards that stand next to other digits, social security and local phone numbers."""
    found: list[tuple[str, int, int]] = []
    if not _DIGIT.search(text):
        return found
    for m in _IBAN.finditer(text):
        want, seen, end = int(_IBAN_LENGTH.get(m.group()[:2], 0)), 0, m.start()
        for c in m.group():
            if seen == want:
                break
            seen += c != " "
            end += 1
        if want and seen == want and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            found.append(("iban", m.start(), end))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 14 and not (14 <= len(d := _digits(m.group())) <= 19 and luhn(d)):
            found += _cards_within(text, *m.span())
    found += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    if "-" in text:
        found += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    return found


def extra(text: str) -> list[tuple[str, int, int]]:
    """The proposed spans whose score reaches ``THRESHOLD``."""
    return [s for s in proposed(text) if score(text, *s) >= THRESHOLD]


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text with their scores."""
    return [(*s, score(text, *s)) for s in sorted({*base(text), *extra(text)}, key=lambda s: (s[1], ORDER[s[0]]))] if text else []


def mask_text(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    out, at, until = [], 0, -1
    for kind, a, b in sorted({*base(text), *extra(text)}, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        if a >= until:
            out += [text[at:a], f"[{kind.upper()}]"]
            until = b
        else:
            until = max(until, b)
        at = until
    return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``keep``, counts, base digest, spans and their scores (0 to 1, in the order of the spans)."""
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("scores", T.StringType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidied(S.scanner(base, extra, BASE, ORDER, keep, text, score)), schema)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` masked; all columns stay."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            new = pa.array([mask_text(t) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(K.tidied(run), docs.schema)
