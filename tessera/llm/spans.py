"""Spans of texts: ``(kind, start, end)`` in code points, end exclusive, and their digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def joined(spans: Iterable[tuple], order: dict[str, int]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(((s[0], s[1], s[2]) for s in spans), key=lambda s: (s[1], order[s[0]], s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def scanner(base: Callable[[str], list], extra: Callable[[str], list], base_kinds: list[str], order: dict[str, int], keep: list[str], text: str, score: Callable[[str, str, int, int], float] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: the columns ``keep``, a count a base kind, the base digest, all spans and, with ``score``, theirs in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in base_kinds}
            sha, spans, scores = [], [], []
            for t in batch.column(text).to_pylist():
                found = base(t) if t else []
                more = extra(t) if t else []
                for k in base_kinds:
                    counts[k].append(sum(s[0] == k for s in found) if found else 0)
                said = joined(found, order) if found else ""
                sha.append(digest(said))
                spans.append(joined({(s[0], s[1], s[2]) for s in [*found, *more]}, order) if more else said)
                if score:
                    named = [x.split(":") for x in spans[-1].split(",")] if spans[-1] else []
                    scores.append(",".join(f"{score(t, k, int(a), int(b)):.2f}" for k, a, b in named))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *(pa.array(counts[k], pa.int64()) for k in base_kinds), pa.array(sha, pa.string()), pa.array(spans, pa.string()), *([pa.array(scores, pa.string())] if score else [])],
                names=[*keep, *(f"n_{k}" for k in base_kinds), "base_sha256", "spans", *(["scores"] if score else [])],
            )

    return run
