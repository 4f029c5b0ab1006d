"""Language identification: nearest of several centroids a language.

A text becomes a TF-IDF vector of hashed byte 1- to 3-grams of its lower-cased letters, scaled to
length 1.  Each language has up to ``CLUSTERS`` centroids from spherical k-means over a bounded
sample of labelled rows; the language of the centroid with the greatest cosine is predicted.  A text
whose cosine is below what ``REJECT`` of its language's own training rows reach is marked rejected.

Defined results: a null text, or one without letters, is ``und`` with score 0; ids and labels of
the predicted rows are never looked at; without training rows everything is ``und``; of equal cosines
the first centroid of the first language in order wins; very long texts count whole; repeated rows get
equal results each; an empty table gives an empty result; other columns are left aside, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .store import ship

#: Labelled rows that are fitted, at most, over all languages.
MAX_FIT_ROWS = 2_000
DIMS, CLUSTERS, ROUNDS, REJECT = 4096, 3, 8, 0.001
#: Rows of a dense block of vectors.
ROWS = 64

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.where(_LETTER, K.LOWER, 32).astype(np.uint8)


def _slots(code: np.ndarray, n: int) -> np.ndarray:
    x = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x85EBCA77)) >> np.uint32(20)


def counts(chunk: K.Chunk) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, [row, DIMS] gram counts)`` for blocks of rows."""
    folded = _FOLD[chunk.data].astype(np.uint32)
    blank = folded == 32
    rows = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))
    for a in range(0, chunk.n, ROWS):
        b = min(a + ROWS, chunk.n)
        lo, hi = int(chunk.offsets[a]), int(chunk.offsets[b])
        f, r, s = folded[lo:hi], rows[lo:hi] - a, blank[lo:hi]
        out = np.zeros((b - a) * DIMS, np.int64)
        for n in (1, 2, 3):
            m = len(f) - n + 1
            if m <= 0:
                break
            code = f[:m].copy()
            for i in range(1, n):
                code = (code << np.uint32(8)) | f[i : i + m]
            keep = r[:m] == r[n - 1 :]
            keep &= ~s[:m] if n == 1 else ~(s[:m] & s[1 : 1 + m])
            out += np.bincount((r[:m] * DIMS + _slots(code, n))[keep], minlength=len(out))
        yield chunk.first + a, out.reshape(b - a, DIMS)


def has_letter(chunk: K.Chunk) -> np.ndarray:
    ascii_letters = np.zeros(256, bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True
    out = chunk.per_row(ascii_letters[chunk.data]) > 0
    for i in np.flatnonzero(~out & (chunk.per_row(chunk.data >= 128) > 0)):
        out[i] = any(c.isalpha() for c in chunk.row_bytes(int(i)).decode("utf-8", "replace"))
    return out


def vectors(counted: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counted.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def predict(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, cosines, whether rejected."""
        cos = vectors(counted, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        lang, score = self.owner[best], cos[np.arange(len(cos)), best]
        return lang, np.clip(score, 0, 1), score < self.floor[lang]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def train(counted: np.ndarray, labels: list[str], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    df = (counted > 0).sum(axis=0)
    idf = (np.log((1 + len(counted)) / (1 + df)) + 1).astype(np.float32)
    x = vectors(counted, idf)
    languages = sorted(set(labels))
    labels_ = np.array(labels)
    parts = [_kmeans(x[labels_ == name], CLUSTERS, rng) for name in languages]
    floor = np.array([np.quantile((x[labels_ == name] @ c.T).max(axis=1), REJECT) for name, c in zip(languages, parts)])
    return Model(languages, idf, np.concatenate(parts).astype(np.float32), np.repeat(np.arange(len(parts)), [len(c) for c in parts]), floor)


def fit(docs: DataFrame, training: Column, lang: str = "lang", key: str = "doc_id", text: str = "text", max_rows: int = MAX_FIT_ROWS) -> Model | None:
    """Fit on at most ``max_rows`` of the rows where ``training`` holds, as many a language, chosen by a hash of their ids."""
    ship(docs.sparkSession)
    labelled = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = labelled.groupBy(lang).count().collect()  # a row a language
    if not per:
        return None
    each = max(1, max_rows // len(per))
    # twice as many and some more are drawn, then `each` stay: no language ends without rows by bad luck
    whole = 1 << 30
    bounds = docs.sparkSession.createDataFrame([(r[lang], int(min(1.0, (2 * each + 20) / r["count"]) * whole)) for r in per], T.StructType([T.StructField("_of", docs.schema[lang].dataType), T.StructField("_bound", T.LongType())]))
    draw = F.xxhash64(F.lit("sample"), F.col(key), F.col(text))
    drawn = labelled.select(F.col(key).cast("string").alias("key"), F.col(lang).alias("_lang"), F.col(text).alias("text"), draw.alias("_draw")).join(F.broadcast(bounds), F.col("_lang") == F.col("_of")).where(F.pmod("_draw", F.lit(whole)) < F.col("_bound"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_draw", F.lit(whole)), "_draw"))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.minimum(row, 65535).astype(np.uint16).tobytes() for c in K.chunks(batch.column("text")) for _, block in counts(c) for row in block]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(found, pa.binary())], names=schema.names)

    sample = drawn.withColumn("_rank", rank).where(F.col("_rank") <= each).select("key", F.col("_lang").cast("string").alias("lang"), "text")
    rows = sample.mapInArrow(K.tidied(run), schema).orderBy("key", "lang", F.md5("counts")).collect()  # MAX_FIT_ROWS, or one a language
    if not rows:
        return None
    return train(np.stack([np.frombuffer(r["counts"], np.uint16) for r in rows]), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``keep``, ``lang_pred``, ``score`` (the cosine), ``rejected``."""
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS * DIMS floats a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            n = batch.num_rows
            lang, score, bad = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
            letters = np.zeros(n, bool)
            for c in K.chunks(batch.column(text)):
                letters[c.first : c.first + c.n] = has_letter(c) & c.valid
                if m is not None:
                    for a, block in counts(c):
                        z = slice(a, a + len(block))
                        lang[z], score[z], bad[z] = m.predict(block)
            ok = letters & (m is not None)
            names = pa.array([m.languages[i] if g else "und" for i, g in zip(lang.tolist(), ok.tolist())] if m is not None else ["und"] * n, pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), names, pa.array(np.where(ok, score, 0.0)), pa.array(bad | ~ok)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidied(run), schema)
