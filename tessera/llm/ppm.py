"""Language-model scores: prediction by partial matching over bytes, beside a smoothed word model.

The byte model is a trie of contexts of up to ``ORDER`` bytes, counted over all training texts.  A
symbol that a context hasn't seen is escaped from (method C: distinct symbols over counts plus
distinct symbols), and the symbols of the longer context are excluded from the shorter one.  A text
is scored with an end symbol; contexts before its first byte are the byte 0xFF, which UTF-8 never has.

Every counted run and word is kept.  Contexts of up to two bytes have ``2**24`` cells at most and are
broadcast; all longer runs, and the words, stay distributed.  What a symbol costs depends only on the
run of ``ORDER + 1`` bytes that it ends, and all contexts of that run end in the same three bytes: counts
are dealt to buckets by these bytes, so that a bucket rates its runs by itself.  The texts to be scored
are dealt to blocks of about ``BLOCK_BYTES``; a block asks once for each of its distinct runs and
words, and its texts are joined with the answers.

Defined results: a null or empty text is scored as its end alone; very long texts are scored
whole; rows that repeat an id are scored one by one; a null id counts as training; with no training
rows bytes are uniform and ``train_tokens`` is 0; an empty table gives an empty result; other
columns are left aside.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .store import ship, table

ORDER = 5
SCORE_BYTES, COUNT_BYTES, BLOCK_BYTES = 1 << 18, 1 << 21, 1 << 24
_END = 255
_WORD, _GRAM = 0, 1
_ODD = K.U64(0x9E3779B97F4A7C15)


def padded(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a lower-cased chunk with ``ORDER`` pads before and an end after each row; each row's first and last symbol."""
    n = np.diff(chunk.offsets)
    rows = np.repeat(np.arange(chunk.n), n)
    out = np.full(len(chunk.data) + (ORDER + 1) * chunk.n, _END, np.uint8)
    out[np.arange(len(chunk.data)) + (ORDER + 1) * rows + ORDER] = chunk.data
    first = chunk.offsets[:-1] + (ORDER + 1) * np.arange(chunk.n) + ORDER
    return out, first, first + n


def runs(symbols: np.ndarray, size: int) -> np.ndarray:
    """Codes of the ``size`` bytes that end at each position from ``size - 1`` on."""
    n = len(symbols) - size + 1
    code = np.zeros(max(n, 0), np.int64)
    for i in range(size):
        code = (code << 8) | symbols[i : i + n]
    return code


def _row_codes(chunk: K.Chunk) -> np.ndarray:
    symbols, first, last = padded(chunk)
    keep = np.zeros(len(symbols) + 1, np.int8)
    keep[first] = 1
    keep[last + 1] -= 1
    return runs(symbols, ORDER + 1)[np.cumsum(keep, dtype=np.int8)[ORDER:-1] > 0]


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1.0))


def _dense(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders 0 to 2: log10 probability of every (context, symbol), and the counts, ``[65536, 256]``."""
    c2 = np.zeros((65536, 256), np.float32)
    c2.reshape(-1)[grams] = counts
    c1 = c2.reshape(256, 256, 256).sum(axis=0, dtype=np.float64)
    c0 = c1.sum(axis=0)
    s1, s0 = c1 > 0, c0 > 0
    n0, u0 = c0.sum(), s0.sum()
    out = np.empty((65536, 256), np.float32)
    below = -np.log10(256 - u0) if u0 < 256 else 0.0

    def step(c: np.ndarray, seen: np.ndarray, n: np.ndarray, u: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """One context's symbols, or an escape and ``rest``; ``n`` and ``u`` are without the excluded symbols."""
        return np.where(seen, _log(c) - _log(n + u), np.where(n + u > 0, _log(u) - _log(n + u), 0.0) + rest)

    n0x = n0 - np.where(s1, c0, 0).sum(axis=1, keepdims=True)
    u0x = u0 - s1.sum(axis=1, keepdims=True)
    low = step(c0[None, :], s0[None, :], n0x, u0x, np.full((256, 256), below))
    n1, u1 = c1.sum(axis=1, keepdims=True), s1.sum(axis=1, keepdims=True)
    for a in range(256):  # contexts (a, b) of all b
        c = c2[a * 256 : a * 256 + 256].astype(np.float64)
        seen = c > 0
        n1x = n1 - np.where(seen, c1, 0).sum(axis=1, keepdims=True)
        u1x = u1 - seen.sum(axis=1, keepdims=True)
        mid = step(c1, s1, n1x, u1x, low)
        out[a * 256 : a * 256 + 256] = step(c, seen, c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True), mid)
    return out, c2


class Lookup:
    """A hash table from distinct runs of ``ORDER + 1`` bytes to their places."""

    def __init__(self, codes: np.ndarray) -> None:
        self.size = len(codes)
        keys = self._keys(codes)
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift = K.U64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, K.U64)
        self.index = np.full(1 << bits, len(keys), np.int32)
        left, at = np.arange(len(keys)), ((keys * _ODD) >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            slots, pick = np.unique(at[free], return_index=True)
            self.keys[slots] = keys[left[free[pick]]]
            self.index[slots] = left[free[pick]]
            stay = np.ones(len(left), bool)
            stay[free[pick]] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    @staticmethod
    def _keys(codes: np.ndarray) -> np.ndarray:
        return codes.astype(K.U64) | K.U64(1 << 56)  # 0 is a free slot

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of runs; ``size`` for one that isn't there."""
        k = self._keys(codes)
        at = ((k * _ODD) >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == k, self.index[at], np.int32(self.size))
        open_ = np.flatnonzero((there != k) & (there != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == k[open_]
            out[open_[hit]] = self.index[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out


class Short:
    """Orders 0 to 2, whole: every (context, symbol)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        logp, c2 = _dense(grams, counts)
        self.logp, self.counts = logp.reshape(-1), c2.reshape(-1)
        self.n, self.u = c2.sum(axis=1, dtype=np.float64), (c2 > 0).sum(axis=1).astype(np.float64)


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each code in the sorted ``keys``, the length for none, and whether it is there."""
    if not len(keys):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.searchsorted(keys, codes)
    hit = keys[np.minimum(at, len(keys) - 1)] == codes
    return np.where(hit, at, len(keys)), hit


def rate(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, short: Short) -> np.ndarray:
    """log10 probability of the last symbol of each run of ``asked``.

    ``grams`` are the counted runs, all of those whose contexts end in the same three bytes as a context of ``asked``.
    """
    low = lambda codes, size: codes & ((1 << 8 * size) - 1)
    nodes = {}
    for size in range(ORDER + 1, 3, -1):
        keys, at = np.unique(low(grams, size), return_inverse=True)
        nodes[size] = keys, np.bincount(at, counts, len(keys))
    out = np.zeros(len(asked))
    done = np.zeros(len(asked), bool)
    # counts and number of the symbols that the longer context excludes
    off_n, off_u = np.zeros(len(asked)), np.zeros(len(asked))
    for size in range(ORDER + 1, 3, -1):
        keys, c = nodes[size]
        contexts, at = np.unique(keys >> 8, return_inverse=True)
        shorter = short.counts[low(keys, 3)].astype(np.float64) if size == 4 else nodes[size - 1][1][np.searchsorted(nodes[size - 1][0], low(keys, size - 1))]
        add = lambda x, k=len(contexts), at=at: np.append(np.bincount(at, x, k), 0.0)  # noqa: E731  (the last stands for no context)
        n, u, excluded = add(c), add(np.ones(len(c))), add(shorter)
        ctx, has = _find(contexts, low(asked, size) >> 8)
        node, hit = _find(keys, low(asked, size))
        left_n, left_u = n[ctx] - off_n, u[ctx] - off_u
        escape = np.where(left_n + left_u > 0, _log(left_u) - _log(left_n + left_u), 0.0)
        out += np.where(has & ~done, np.where(hit, _log(np.append(c, 0.0)[node]) - _log(left_n + left_u), escape), 0.0)
        done |= hit
        off_n, off_u = np.where(has, excluded[ctx], off_n), np.where(has, u[ctx], off_u)
    code = low(asked, 3)
    n, u = short.n[code >> 8], short.u[code >> 8]
    left_n, left_u = n - off_n, u - off_u
    escape = np.where(left_n + left_u > 0, _log(left_u) - _log(left_n + left_u), 0.0) - np.where(n + u > 0, _log(u) - _log(n + u), 0.0)
    fix = np.where(short.counts[code] > 0, _log(n + u) - _log(left_n + left_u), escape)
    return out + np.where(done, 0.0, short.logp[code] + fix)


@dataclass
class Model:
    """``short``: orders 0 to 2, runs of three bytes and their counts; ``counts(kind, h, n)``: longest runs and words, distributed."""

    short: tuple[np.ndarray, np.ndarray]
    counts: DataFrame
    size: int
    tokens: int
    kinds: int
    texts: int


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all of ``docs``."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())])

    def rows(kind: int, keys: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(keys, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column("text"), COUNT_BYTES):
                low = chunk.lowered()
                yield rows(_WORD, K.words(low, K.NOT_SPACE).hashes())
                yield rows(_GRAM, _row_codes(low))

    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("kind", "h").agg(F.sum("n").alias("n"))
    counted = table(counted, "lm-counts")
    grams = counted.where(F.col("kind") == _GRAM)
    short = grams.groupBy(F.col("h").bitwiseAND((1 << 24) - 1).alias("h")).agg(F.sum("n").alias("n")).toPandas().sort_values("h")  # 2**24 rows at most
    size, kinds, tokens = counted.agg(F.count("*"), F.count(F.when(F.col("kind") == _WORD, 1)), F.coalesce(F.sum(F.when(F.col("kind") == _WORD, F.col("n"))), F.lit(0))).first()
    return Model((short["h"].to_numpy(np.int64), short["n"].to_numpy(np.int64)), counted, int(size), int(tokens), int(kinds), docs.count())


_built: dict[str, Short] = {}  # of the model in use, once a worker


def _sorted(kind: pa.ChunkedArray, h: pa.ChunkedArray, v: pa.ChunkedArray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a kind, in order, and their values."""
    z = kind.to_numpy() == which
    h, v = h.to_numpy()[z], v.to_numpy()[z]
    order = np.argsort(h)
    return h[order], v[order]


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``keep``, ``n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    ship(spark)
    tokens = model.tokens + model.texts  # ends count
    kinds = model.kinds + (model.texts > 0)
    unit = float(np.log10(tokens + 0.5 * (kinds + 1)))
    end = float(np.log10(model.texts + 0.5))
    some = int(model.texts > 0)
    held = spark.sparkContext.broadcast(model.short)
    token = uuid.uuid4().hex
    names = [f"_k{i}" for i in range(len(keep))]
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    buckets = max(blocks, -(-model.size // (1 << 19)))
    field = T.StructField
    laid = docs.select(*(F.col(k).alias(n) for n, k in zip(names, keep)), F.col(text).alias("_text"))
    laid = laid.withColumn("_block", F.pmod(F.xxhash64(*laid.columns), F.lit(blocks)).cast("int")).repartition("_block")
    asks = T.StructType([field("bucket", T.LongType()), field("block", T.IntegerType()), field("kind", T.IntegerType()), field("h", T.ArrayType(T.LongType()))])
    tells = T.StructType([field("block", T.IntegerType()), field("kind", T.IntegerType()), field("h", T.ArrayType(T.LongType())), field("v", T.ArrayType(T.DoubleType()))])

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        """The distinct words and runs of a block, a row a bucket."""
        found: tuple[list, list] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in rows.to_batches():
            for chunk in K.chunks(batch.column("_text"), COUNT_BYTES):
                low = chunk.lowered()
                found[_WORD].append(np.unique(K.words(low, K.NOT_SPACE).hashes().view(np.int64)))
                found[_GRAM].append(np.unique(_row_codes(low)))
        out = []
        for kind, parts in enumerate(found):
            keys = np.unique(np.concatenate(parts))
            bucket = np.mod(keys, buckets) if kind == _WORD else (((keys >> 8 & 0xFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 8) % buckets
            keys = keys[np.argsort(bucket, kind="stable")]
            at, n = np.unique(bucket, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(keys))
            out.append(pa.table([pa.array(at, pa.int64()), pa.array([key[0].as_py()] * len(at), pa.int32()), pa.array([kind] * len(at), pa.int32()), lists], names=asks.names))
        return pa.concat_tables(out)

    def answer(counted: pa.Table, asked: pa.Table) -> pa.Table:
        """A bucket's answers: a word's count, a run's log10 probability."""
        if token not in _built:
            _built.clear()
            _built[token] = Short(*held.value)
        asked = asked.combine_chunks()
        out = []
        for kind in (_WORD, _GRAM):
            keys, n = _sorted(counted.column("kind"), counted.column("h"), counted.column("n"), kind)
            some_ = asked.filter(pc.equal(asked.column("kind"), kind)).combine_chunks()
            if not some_.num_rows:
                continue
            h = pc.list_flatten(some_.column("h")).to_numpy()
            if kind == _WORD:
                at, _ = _find(keys, h)
                v = np.append(n, 0)[at].astype(np.float64)
            else:
                once, at = np.unique(h, return_inverse=True)
                v = rate(once, keys, n, _built[token])[at]
            offsets = pa.array(np.cumsum([0, *pc.list_value_length(some_.column("h")).to_numpy()]), pa.int32())
            out.append(pa.table([some_.column("block"), some_.column("kind"), pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(v))], names=tells.names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], names=tells.names)

    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*(field(n, docs.schema[k].dataType) for n, k in zip(names, keep)), *(field(n, t) for n, t in fields)])

    def finish(rows: pa.Table, told: pa.Table) -> pa.Table:
        """The scores of a block's texts."""
        size = pc.list_value_length(told.column("h")).to_numpy()
        kind, h, v = pa.chunked_array([np.repeat(told.column("kind").to_numpy(), size)]), pc.list_flatten(told.column("h")), pc.list_flatten(told.column("v"))
        words, counts = _sorted(kind, h, v, _WORD)
        grams, logp = _sorted(kind, h, v, _GRAM)
        weight = np.log10(counts + 0.5)
        lookup = Lookup(grams)
        out: list[list] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for batch in rows.to_batches():
            for chunk in K.chunks(batch.column("_text"), SCORE_BYTES):
                low = chunk.lowered()
                w = K.words(low, K.NOT_SPACE)
                at = np.searchsorted(words, w.hashes().view(np.int64))
                known, part = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1)
                np.cumsum(counts[at] > 0, out=known[1:])
                np.cumsum(weight[at], out=part[1:])
                rates = np.zeros(len(low.data) + low.n + 1)
                np.cumsum(logp[lookup.find(_row_codes(low))], out=rates[1:])
                n = w.counts.astype(np.int64) + 1
                out[0].append(n)
                out[1].append(np.diff(known[w.bounds]) + some)
                out[2].append(np.diff(part[w.bounds]) + end - n * unit)
                out[3].append(np.diff(rates[low.offsets + np.arange(low.n + 1)]))
        return pa.table([*(rows.column(n) for n in names), *(pa.array(np.concatenate(c)) for c in out)], names=schema.names)

    gram = F.col("h")
    ending = F.shiftright(gram, 8).bitwiseAND(0xFFFFFF) * F.lit(0x9E3779B1)
    bucket = F.when(F.col("kind") == _WORD, F.pmod(gram, F.lit(buckets))).otherwise(F.pmod(F.shiftright(ending.bitwiseAND(0xFFFFFFFF), 8), F.lit(buckets)))
    counted = model.counts.withColumn("bucket", bucket.cast("long")).groupBy("bucket")
    told = counted.cogroup(laid.groupBy("_block").applyInArrow(ask, asks).groupBy("bucket")).applyInArrow(answer, tells)
    scored = laid.groupBy("_block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)
    return scored.select(*(F.col(m).alias(k) for m, k in zip(names, keep)), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def split(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold``; false for null."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(False))
