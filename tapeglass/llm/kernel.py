"""Word and window hashes of whole texts, on the UTF-8 bytes of Arrow columns.

A chunk holds whole texts only.  Hashes are polynomials modulo 2**64 taken from running sums, so their cost is a few
nanoseconds a byte however long a text is; a final mixing step spreads them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
CHUNK_BYTES, CHUNK_TEXTS = 1 << 19, 1 << 14
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
INVERSE, WORD_INVERSE = pow(BASE, -1, 1 << 64), pow(WORD_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random value for every byte, and another one for hashes that are independent of the first.
BYTE, BYTE2 = mix(np.arange(256, dtype=U), 7), mix(np.arange(256, dtype=U), 8)


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, U(base))
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


@dataclass
class Chunk:
    first: int  # row of the batch at which it starts
    n: int  # texts
    buf: np.ndarray  # bytes of all texts
    cuts: np.ndarray  # n + 1 offsets of texts in buf
    null: np.ndarray  # per text

    _words: tuple | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words in buf, and n + 1 offsets of texts among the words."""
        if self._words is None:
            inside = ~SPACE[self.buf]
            before = np.empty_like(inside)
            before[1:] = inside[:-1]
            edge = self.cuts[:-1][self.cuts[:-1] < len(inside)]
            before[:1] = False
            before[edge] = False
            starts = np.flatnonzero(inside & ~before)
            after = np.empty_like(inside)
            after[:-1] = inside[1:]
            after[-1:] = False
            ends = self.cuts[1:]
            after[ends[ends > 0] - 1] = False
            self._words = starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, self.cuts)
        return self._words

    def hashes(self, lower: bool = False, byte: np.ndarray = BYTE) -> np.ndarray:
        """A 64-bit hash of every word."""
        starts, ends, _ = self.words()
        return span_hashes(LOWER[self.buf] if lower else self.buf, starts, ends, byte)

    def owner(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), counts)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray = BYTE) -> np.ndarray:
    return value_hashes(byte[buf], starts, ends) if len(starts) else np.zeros(0, U)


def value_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values from each start to its end."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(values) + 1)[starts] + (ends - starts).astype(U))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values (those across a text's end too: the caller leaves them out)."""
    if len(values) < k:
        return np.zeros(0, U)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(WORD_BASE, len(values)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(WORD_INVERSE, len(values) - k + 1), k)


def run_hashes(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of ``size`` consecutive values from each place on."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(WORD_BASE, len(values)), out=total[1:])
    return mix((total[at + size] - total[at]) * powers(WORD_INVERSE, len(values) + 1)[at] + size.astype(U) * U(BASE))


def windows_inside(cuts: np.ndarray, k: int) -> np.ndarray:
    """Which windows of k lie inside one text, given the texts' offsets among the words."""
    n = int(cuts[-1])
    ok = np.ones(max(0, n - k + 1), bool)
    for j in range(1, k):
        at = cuts[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


#: Bytes of rows that Spark hands to a worker at once: texts differ in length by orders of magnitude, their number says little.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on bounds the bytes of Arrow batches, unless it has a bound of its own."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives back memory that it does not use.

    Workers outlive their tasks; what the allocators of an idle one hold would be missing to the executor's next stages.
    """

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
            if trim is not None:
                trim(0)

    return then


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of whole texts; nulls have no bytes.  A text longer than ``most`` is a chunk of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    bits, offs, data = texts.buffers()
    cuts = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else np.zeros(n, bool)
    at = 0
    while at < n:
        to = int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1
        to = min(max(to, at + 1), at + CHUNK_TEXTS, n)
        yield Chunk(at, to - at, buf[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at], null[at:to])
        at = to
