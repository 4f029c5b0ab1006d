"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, field

RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
RDFS_LABEL = "<http://www.w3.org/2000/01/rdf-schema#label>"
XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class FtsConfig:
    """Full-text settings; ``stemmer`` is ``none`` or ``porter``, ``stopwords`` ``none`` or ``english``."""

    k: float = 1.2
    b: float = 0.75
    stemmer: str = "porter"
    stopwords: str = "english"


@dataclass(frozen=True)
class EngineConfig:
    page_size: int = 999
    spo_size: int = 1000
    semantic_distance: float = 0.5
    languages: tuple[str, ...] = ("de", "en")
    async_timeout_s: float = 60.0
    cache_ttl_s: float = 7 * 24 * 3600.0
    #: Key sets of at most this many rows are broadcast; larger ones are joined by shuffle.
    fts: FtsConfig = field(default_factory=FtsConfig)
