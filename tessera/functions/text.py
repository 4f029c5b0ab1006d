"""Full-text tokens as columns: lower case, no accents, runs of ASCII letters and digits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FtsConfig
from .porter import stem

_ACCENTED = [chr(i) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(i))) > 1]
_FROM = "".join(_ACCENTED)
_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
STOPWORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(s: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def one(w: str) -> str:
        if w not in known:
            known[w] = stem(w)
        return known[w]

    return s.map(lambda ws: None if ws is None else [one(w) for w in ws])


def folded(c: Column) -> Column:
    """Lower case without accents; texts in ASCII skip the table of accents."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.lower(F.translate(low, _FROM, _TO))).otherwise(low)


def tokens(c: Column, config: FtsConfig) -> Column:
    """The tokens of a text column."""
    words = F.filter(F.split(folded(c), "[^a-z0-9]+"), lambda w: w != "")
    if config.stopwords == "english":
        words = F.filter(words, lambda w: ~w.isin(*sorted(STOPWORDS)))
    return _stemmed(words) if config.stemmer == "porter" else words


def query_tokens(text: str, config: FtsConfig) -> list[str]:
    """The distinct tokens of a query, by the same rules."""
    low = text.lower().translate(str.maketrans(_FROM, _TO)).lower()
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in low).split()]
    if config.stopwords == "english":
        words = [w for w in words if w not in STOPWORDS]
    if config.stemmer == "porter":
        words = [stem(w) for w in words]
    return list(dict.fromkeys(words))
