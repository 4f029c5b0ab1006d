"""Vectorised text kernels over Arrow string buffers.

Every function here sees a *chunk*: some whole rows of a string column as one byte
buffer with row offsets.  Word boundaries, counts and 64-bit word hashes come from
numpy passes over the bytes, so no Python loop touches a character.  A null text is
an empty text with ``valid`` false.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
KEPT_POWERS = 1 << 20
U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=U64)
_BASE = int(_rng.integers(0, 1 << 61)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LANE = _rng.integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
_powers: dict[int, np.ndarray] = {}

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z, all of code points from 128).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes that begin a code point.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, U64(base), U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= KEPT_POWERS:  # those of a very long text aren't held on to
            _powers[base] = have
    return have[:n]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and then what it freed goes back to the system: Python workers live longer than tasks."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # not every C library has it
                trim(0)

    return both


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Chunk:
    """Rows ``first .. first+n`` of a batch as bytes ``data`` cut at ``offsets``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Chunk:
        return Chunk(self.first, LOWER[self.data], self.offsets, self.valid)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each row has."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def row_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into runs of whole rows of about ``limit`` bytes (a longer row stands alone)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield Chunk(a, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], valid[a:b])
        a = b


@dataclass
class Words:
    """Words of a chunk: byte spans, owning rows, words before each row, 64-bit hashes on demand."""

    chunk: Chunk
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.counts)

    def hashes(self) -> np.ndarray:
        data = self.chunk.data
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:], dtype=U64)
        return mix((total[self.ends] - total[self.starts]) * _power(_BASE_INV, len(data) + 1)[self.starts] + U64(1))


def words(chunk: Chunk, alphabet: np.ndarray) -> Words:
    inside = alphabet[chunk.data]
    begin, end = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = chunk.offsets[(chunk.offsets > 0) & (chunk.offsets < len(inside))]
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return Words(chunk, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, chunk.offsets))


def hash_word(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text that isn't null."""
    (chunk,) = chunks(pa.array([text], pa.string()))
    return words(chunk.lowered(), alphabet).hashes()


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, as if the chunk were one row; there are ``len(hashes)-k+1``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = hashes[:n] * _LANE[0]
    for i in range(1, k):
        total += hashes[i : i + n] * _LANE[i]
    return mix(total)


def inside_rows(w: Words, k: int) -> np.ndarray:
    """Which windows of ``k`` words lie inside one row."""
    rows = w.rows
    n = len(rows) - k + 1
    return rows[:n] == rows[k - 1 :] if n > 0 else np.zeros(0, bool)


def crc_mod(ids: list, m: int) -> list:
    """crc32 of the ids as text, modulo ``m``; null for null."""
    import zlib

    return [None if i is None else zlib.crc32(str(i).encode()) % m for i in ids]
