"""The request language: dictionaries in, validated specifications out."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..config import EngineConfig

OPS = {"should": "or", "or": "or", "must": "and", "and": "and", "not": "not"}


@dataclass(frozen=True)
class Filter:
    """One filter; ``kind`` is object, pair, predicate, id, random, fts, regex or semantic."""

    kind: str
    op: str = "or"
    predicate: str | None = None
    objects: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    text: str = ""
    hops: int = 0
    prop: str | None = None
    count: int = 1


@dataclass(frozen=True)
class OrderRule:
    by: str = "label"
    prop: str | None = None
    via: str | None = None
    lang: tuple[str, ...] = ()
    dir: str = "asc"
    nulls: str = "last"
    mode: str = "lex"
    natural: bool = False
    clean: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class QuerySpec:
    filters: tuple[Filter, ...] = ()
    size: int = 999
    start: int = 0
    order: OrderRule | None = None
    aggregates: tuple[str, ...] = ()
    only_properties: tuple[str, ...] = ()
    exclude_properties: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    use_cache: bool = True


def hops_and_prop(p: str) -> tuple[int, str | None]:
    """What follows a filter's keyword or predicate: hops, then a property, each optional."""
    rest = [x for x in p.split(" ") if x][1:]
    hops = int(rest.pop(0)) if rest and rest[0].isdigit() else 0
    prop = rest[0] if rest and rest[0].startswith("<") and rest[0].endswith(">") else None
    return hops, prop


def _number(value: object, default: int) -> int:
    try:
        return max(0, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def _objects(o: str) -> tuple[str, ...]:
    return tuple(x for x in o.split(" ") if x) if o.startswith("<") and o.endswith(">") and " " in o else (o,)


def parse_filter(raw: dict) -> Filter:
    p, o, g = (str(raw.get(k) or "").strip(" ") for k in "pog")
    op = str(raw.get("op") or "should").lower()
    if op not in OPS:
        raise ValueError(f"unknown op {op!r}")
    base = {"op": OPS[op], "graphs": tuple(x for x in g.split(" ") if x)}
    if p == "id":
        words = o.split(" ")
        if words[0] == "random":
            return Filter("random", count=_number(words[1] if len(words) > 1 else None, 1) or 1, **base)
        return Filter("id", objects=_objects(o), **base)
    if not p:
        if not o:
            raise ValueError("a filter needs p or o")
        return Filter("object", objects=_objects(o), **base)
    hops, prop = hops_and_prop(p)
    for kind in ("fts", "regex", "semantic"):
        if p.startswith(kind):
            return Filter(kind, text=o, hops=hops, prop=prop, **base)
    if p.startswith("<"):
        predicate = p.split(" ")[0]
        return Filter("pair" if o else "predicate", predicate=predicate, objects=_objects(o) if o else (), hops=hops, **base)
    raise ValueError(f"unknown filter {p!r}")


def parse_order(raw: object) -> OrderRule | None:
    while isinstance(raw, (list, tuple)):
        raw = raw[0] if raw else None
    if not raw:
        return None
    r = dict(raw)  # type: ignore[call-overload]
    by = r.get("by", "label")
    if by not in ("label", "property", "object_label"):
        raise ValueError(f"unknown order {by!r}")
    if by == "property" and not r.get("prop"):
        raise ValueError("order by property needs prop")
    if by == "object_label" and not r.get("via"):
        raise ValueError("order by object_label needs via")
    lang = r.get("lang") or ()
    return OrderRule(by, r.get("prop"), r.get("via"), (lang,) if isinstance(lang, str) else tuple(lang), str(r.get("dir", "asc")).lower(), str(r.get("nulls", "last")).lower(), str(r.get("mode", "lex")).lower(), bool(r.get("natural")), dict(r.get("clean") or {}))


def parse(opts: dict, config: EngineConfig | None = None) -> QuerySpec:
    config = config or EngineConfig()
    seq = lambda k: tuple(opts.get(k) or ())
    return QuerySpec(
        tuple(parse_filter(f) for f in opts.get("filters") or ()), _number(opts.get("size", config.page_size), config.page_size), _number(opts.get("start", 0), 0), parse_order(opts.get("order")),
        seq("aggregates"), seq("only_properties"), seq("exclude_properties"), seq("paths"), bool(opts.get("use_cache", True)),
    )
