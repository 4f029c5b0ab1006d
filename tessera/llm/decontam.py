"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words (lower-cased; digits, letters and all beyond ASCII).  An item of ``n`` words is
found where some run of a document is within ``allowed(n)`` word edits of it.

An item of up to ``PART`` words is one window; a longer one is cut into equal windows of that size
at most, one of which holds no more than its share of the edits.  A window walks through the CGK
embedding: a step copies the current word and moves on or stays by a random bit of word and step,
which turns edit distance into Hamming distance.  Every place of a document begins a walk with the
same bits.  A table samples ``BITS`` steps of one of ``WALKS`` independent walks; a place that agrees
with a window in all of them is a candidate.  Long windows are looked for from every ``STRIDE``-th place
only, and stand in the tables at as many shifts.  ``TABLES`` tables for each class of window sizes reach
the target recall (tests measure it at the allowed edits); nothing else proposes candidates.  The
steps stay where the item still has words, so padding never counts as agreement.  Candidates whose
surroundings lack too many of the item's words, or of its distinct words, can't match and go.  The exact least
edit distance of the whole item to any run of the candidate's surroundings decides.

Defined results: null and empty texts, and items without words, match nothing; items of up to three
words match exactly; very long texts are searched whole; repeated rows each get their own result,
and so do items that repeat an id or a text; of several places of an item in a row the one with the
fewest edits, then the first, then the shortest is told; ids may be null and of any type; empty
tables give an empty result; other columns are left aside, whatever their names (``clean`` passes
them through).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel as K
from .store import ship

SHARE = 0.25
#: Words of a window, at most; the shortest window of each class of window sizes.
PART, CLASSES = 12, (1, 2, 3, 4, 6, 9)
WALKS, TABLES, BITS, GAP = 12, 96, 4, 2
#: Windows of this many words and more begin at every ``STRIDE``-th place of a chunk only; items have them at as many shifts.
LONG, STRIDE = 8, 4
#: Steps of a walk, for each word of the shortest window of a class: a walk takes a word in two steps, about.
STEPS = 1.6
#: Item text that is broadcast at once (about ten times that as tables); more items are searched in as many blocks, each over all documents.
BLOCK_BYTES = 4 << 20
_WIDTH, CHUNK_BYTES = 512, 1 << 19


def allowed(n: int) -> int:
    """Edits that an item of ``n`` words may differ by."""
    return int(SHARE * n)


def folded(column: pa.Array) -> Iterator[K.Chunk]:
    """Chunks of the lower-cased texts, in whatever script."""
    return K.chunks(pc.utf8_lower(column), CHUNK_BYTES)


def _bits(words: np.ndarray, walk: int) -> np.ndarray:
    """The random bits of each word, one a step, and none for the place beyond the last word."""
    salt = K.U64((walk + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return np.append((K.mix(words + salt) >> K.U64(1)).view(np.int64), 0)


def embed(words: np.ndarray, bits: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A CGK walk from each of ``starts``: at every step, the places it stands at (valid until the next step) and the words there.

    ``words`` and ``bits`` have one more entry than there are words: a walk stays there.
    """
    at = starts.astype(np.int64)
    move = np.empty_like(at)
    for j in range(steps):
        yield at, words.take(at, mode="clip")
        bits.take(at, mode="clip", out=move)
        move >>= j
        move &= 1
        at += move


def distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a run of ``text``, and that run's end (the first best one)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Table:
    """Samples of one walk: windows by a hash of their words at ``steps``."""

    walk: int
    stride: int
    steps: list[int]
    keys: np.ndarray
    #: where each key's windows begin in ``Items.which``, less ``base``
    first: np.ndarray
    base: int
    #: sums of the first two sampled words
    pairs: np.ndarray

    def __post_init__(self) -> None:
        self.shift, self.likely = self._bitmap(self.keys, 20)
        self.pair_shift, self.likely_pair = self._bitmap(self.pairs, 17)

    @staticmethod
    def _bitmap(keys: np.ndarray, most: int) -> tuple[np.uint64, np.ndarray]:
        """Which leading bits ``keys`` have."""
        bits = min(most, max(14, int(len(keys) * 16).bit_length()))
        out = np.zeros(1 << bits, bool)
        out[(keys >> K.U64(64 - bits)).astype(np.int64)] = True
        return K.U64(64 - bits), out

    def __getstate__(self) -> dict:
        return {f: getattr(self, f) for f in self.__dataclass_fields__}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def find(self, lanes: dict[tuple[int, int], np.ndarray], walked: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Which places agree with windows, and the windows' slots; ``lanes`` are the first two factors of the sum."""
        total = lanes[self.steps[0], 0] + lanes[self.steps[1], 1]
        at = np.flatnonzero(self.likely_pair.take((total >> self.pair_shift).view(np.int64), mode="clip"))
        key = total.take(at)
        for j, lane in zip(self.steps[2:], K._LANE[2:]):
            key += walked[j].take(at) * lane
        key = K.mix(key)
        hit = np.flatnonzero(self.likely.take((key >> self.shift).view(np.int64), mode="clip"))
        at, key = at[hit], key[hit]
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[slot] == key
        return at[ok], slot[ok]


@dataclass
class Items:
    """Items of a block as word hashes, cut into windows, and the tables of the windows' sampled walks."""

    ids: list
    words: np.ndarray
    bounds: np.ndarray
    #: the items' words, sorted, and a bitmap of their leading bits
    vocabulary: np.ndarray
    likely: np.ndarray
    #: which words (their numbers modulo ``_WIDTH``) each item has
    bag: np.ndarray
    #: each window's item and first word
    owner: np.ndarray
    offset: np.ndarray
    #: windows by table and key
    which: np.ndarray
    tables: list[Table]

    def number(self, words: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, from 1; 0 for others."""
        out = np.zeros(len(words), np.int64)
        at = np.flatnonzero(self.likely[(words >> K.U64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.vocabulary, words[at]), max(0, len(self.vocabulary) - 1))
        hit = self.vocabulary[slot] == words[at] if len(self.vocabulary) else np.zeros(0, bool)
        out[at[hit]] = slot[hit] + 1
        return out


def _sample(reach: int, bits: int, rng: np.random.Generator) -> list[int]:
    """Steps ``GAP`` apart at least: neighbours often stand on the same word."""
    return (np.sort(rng.choice(reach - (GAP - 1) * (bits - 1), bits, replace=False)) + (GAP - 1) * np.arange(bits)).tolist()


def _cuts(n: int) -> Iterator[tuple[int, int, int]]:
    """Windows of an item of ``n`` words: begin, end, stride."""
    if n < LONG + STRIDE - 1:
        yield 0, n, 1
        return
    k = -(-n // PART)
    for a, b in ((n * x // k, n * (x + 1) // k) for x in range(k)):
        for d in range(STRIDE):
            yield (a - d, b - d, STRIDE) if a else (d, min(b + d, n), STRIDE)


def compile_items(ids: list, texts: list[str | None], seed: int = 23) -> Items:
    rows = [(i, h) for i, t in zip(ids, texts) if t and len(h := K.words(next(folded(pa.array([t], pa.string()))), K.ALNUM).hashes())]
    ids, runs = [i for i, _ in rows], [h for _, h in rows]
    bounds = np.cumsum([0, *map(len, runs)])
    words = np.concatenate(runs) if runs else np.zeros(0, K.U64)
    vocabulary = np.unique(words)
    likely = np.zeros(1 << 20, bool)
    likely[(vocabulary >> K.U64(44)).astype(np.int64)] = True
    cuts = [(i, *c) for i, h in enumerate(runs) for c in _cuts(len(h))]
    owner, begin, end, stride = np.array(cuts, np.int64).reshape(-1, 4).T
    out = Items(ids, words, bounds, vocabulary, likely, np.zeros((len(ids), _WIDTH), bool), owner, begin, np.zeros(0, np.int64), [])
    starts, size = bounds[owner] + begin, end - begin
    out.bag[np.repeat(np.arange(len(ids)), np.diff(bounds)), out.number(words) % _WIDTH] = True
    kind = np.searchsorted(CLASSES, size, "right") - 1 + len(CLASSES) * (stride > 1)
    rng = np.random.default_rng(seed)
    which: list[np.ndarray] = []
    for c, least in enumerate([*CLASSES, *CLASSES]):
        one = allowed(least) == 0  # nothing may differ: a table of the first and the last word
        reach = max(least, int(STEPS * least))
        plans = [(0, [0, least - 1])] if one else [(t % WALKS, _sample(reach, min(BITS, 2 * least // 3 if c >= len(CLASSES) else least // 2), rng)) for t in range(TABLES)]
        z = np.flatnonzero(kind == c)
        if not len(z):
            continue
        for walk in sorted({w for w, _ in plans}):
            far = max(p[-1] for w, p in plans if w == walk) + 1
            walked = [(at.copy(), x) for at, x in embed(np.append(words, K.U64(0)), _bits(words, walk), starts[z], far)]
            for steps in (p for w, p in plans if w == walk):
                inside = np.all([walked[j][0] < starts[z] + size[z] for j in steps], axis=0)
                if not inside.any():
                    continue
                parts = [(walked[j][1] * lane)[inside] for j, lane in zip(steps, K._LANE)]
                key = K.mix(sum(parts[1:], parts[0]))
                order = np.argsort(key, kind="stable")
                keys, first = np.unique(key[order], return_index=True)
                out.tables.append(Table(walk, STRIDE if c >= len(CLASSES) else 1, steps, keys, np.append(first, len(order)), sum(map(len, which)), np.unique(parts[0] + parts[1])))
                which.append(z[inside][order])
    out.which = np.concatenate(which) if which else out.which
    return out


def candidates(items: Items, hashes: np.ndarray, w: K.Words) -> np.ndarray:
    """``[item, start, row]`` of places that agree with a window in some table; ``start`` is where the item would begin, in words of the chunk."""
    found = []
    n = len(hashes)
    ids = items.number(hashes)
    walked_words = np.append(hashes, K.U64(0))
    back = int(items.offset.max(initial=0))
    span = n + back + 1
    for stride, walk in sorted({(t.stride, t.walk) for t in items.tables}):
        tables = [t for t in items.tables if (t.stride, t.walk) == (stride, walk)]
        need = {j for t in tables for j in t.steps}
        walked = {j: x for j, (_, x) in enumerate(embed(walked_words, _bits(hashes, walk), np.arange(0, n, stride), max(need) + 1)) if j in need}
        lanes = {(j, k): walked[j] * K._LANE[k] for k in (0, 1) for j in {t.steps[k] for t in tables}}
        for t in tables:
            at, slot = t.find(lanes, walked)
            if len(at):
                found.append((at * stride, t.first[slot] + t.base, t.first[slot + 1] - t.first[slot]))
    if not found:
        return np.zeros((0, 3), np.int64)
    place, first, many = (np.concatenate(x) for x in zip(*found))
    which = items.which.take(np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum()))
    place = np.repeat(place, many)
    found = (items.owner[which] * w.chunk.n + np.searchsorted(w.bounds, place, "right") - 1) * span + place - items.offset[which] + back
    found.sort()
    code = found[np.append(True, found[1:] != found[:-1])]
    item, row = np.divmod(code // span, w.chunk.n)
    start = code % span - back
    # a match has all but the allowed edits of the item's words, and of its distinct words, in its surroundings
    size = np.diff(items.bounds)[item]
    edits = (SHARE * size).astype(np.int64)
    lo, hi = np.maximum(w.bounds[row], start - edits), np.minimum(w.bounds[row + 1], start + size + edits)
    many = np.maximum(hi - lo, 0)
    keep = np.zeros(len(item), bool)
    kinds = items.bag.sum(axis=1)
    for z in _slices(many + 16):
        m = many[z]
        which = np.repeat(np.arange(len(m)), m)
        x = ids[np.repeat(lo[z] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        slot = x & (_WIDTH - 1)
        there = np.flatnonzero(items.bag.reshape(-1).take(np.repeat(item[z] * _WIDTH, m) + slot) & (x > 0))
        owner = which.take(there)
        ok = np.bincount(owner, minlength=len(m)) >= (size - edits)[z]
        there = there[ok.take(owner)]
        rank = np.cumsum(ok) - 1
        present = np.zeros((int(ok.sum()), _WIDTH), bool)
        present[rank[which.take(there)], slot.take(there)] = True
        ok[ok] = present.sum(axis=1) >= (kinds[item[z]] - edits[z])[ok]
        keep[z] = ok
    return np.stack([item, start, row], 1)[keep]


def _slices(many: np.ndarray, limit: int = 1 << 20) -> Iterator[slice]:
    """Runs of rows that have ``limit`` words together, about."""
    cut = np.flatnonzero(np.diff(np.cumsum(many) // limit)) + 1
    bounds = [0, *cut.tolist(), len(many)]
    return (slice(a, b) for a, b in zip(bounds, bounds[1:]) if a < b)


def search(items: Items, chunk: K.Chunk) -> list[tuple[int, int, int, int, int]]:
    """Matches of a lower-cased chunk: ``(row, item, edits, start, end)`` in words of the row, the best and first a row and item."""
    w = K.words(chunk, K.ALNUM)
    hashes = w.hashes()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, start, row in candidates(items, hashes, w).tolist():
        a, b = items.bounds[item], items.bounds[item + 1]
        n = int(b - a)
        d = allowed(n)
        lo, hi = int(w.bounds[row]), int(w.bounds[row + 1])
        x, y = max(lo, start - d), min(hi, start + n + d)
        pattern, text = items.words[a:b].tolist(), hashes[x:y].tolist()
        edits, end = distance(pattern, text)
        if edits > d:
            continue
        back, length = distance(pattern[::-1], text[:end][::-1])
        value = (edits, x + end - length - lo, x + end - lo)
        key = (row, item)
        if key not in best or value < best[key]:
            best[key] = value
    return [(chunk.first + r, i, *v) for (r, i), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    b = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        rows = b.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()
        rows.sort(key=lambda r: (r["i"] is None, 0 if r["i"] is None else r["i"], r["t"] or ""))
        yield compile_items([r["i"] for r in rows], [r["t"] for r in rows])


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, edits, start, end, item_words``: a row a document row and item found in it."""
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), *(T.StructField(n, T.LongType()) for n in ("edits", "start", "end", "item_words"))])
    kind = to_arrow_type(benchmark.schema[item].dataType)
    d = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = None
    for items in _blocks(benchmark, item, text):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            x = held.value
            for batch in batches:
                found = [m for c in folded(batch.column("_text")) for m in search(x, c)]
                cols = [batch.column("_key").take(pa.array([m[0] for m in found], pa.int64())), pa.array([x.ids[m[1]] for m in found], kind), *(pa.array([int(m[i]) for m in found], pa.int64()) for i in (2, 3, 4)), pa.array([int(x.bounds[m[1] + 1] - x.bounds[m[1]]) for m in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        part = d.mapInArrow(K.tidied(run), schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay, nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    for items in _blocks(benchmark, item, text):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                column = batch.column(batch.schema.get_field_index(text))
                keep[[m[0] for c in folded(column) for m in search(held.value, c)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(K.tidied(run), docs.schema)
    return docs
