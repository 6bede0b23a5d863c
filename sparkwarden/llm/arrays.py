"""Vectorised access to the text of an Arrow batch: bytes, words, word hashes and pretokens.

Everything here works on whole texts, a slice of rows at a time, without a
Python loop over characters.  Null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked on in slices of about this many bytes, so that the arrays
#: derived from it stay small; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows go to a worker in batches of about this many bytes.
BATCH_BYTES = 4 << 20

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None
_U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and an odd base for positions.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
BASE = _U64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def eased(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, what its arrays took goes back to the system, so that a worker holds no more than its largest batch needs."""
    for batch in batches:
        yield batch
        del batch
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def batched(spark) -> None:
    """Sets batches of ``BATCH_BYTES`` for this session, unless it has a bound of its own.

    Executor and worker each hold a batch, or two while it grows, outside the heap; Spark's bound is 64 MB."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def powers(n: int) -> np.ndarray:
    """``BASE ** i`` modulo 2**64 for ``i < n``."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit of ``h`` counts."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(29))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(32))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each, from 0."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - lo


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, each of one row at least."""
    if len(texts) == 0:
        return
    offsets = raw(texts)[1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def word_table(fold: bool) -> np.ndarray:
    """Byte to byte: 0 outside words; letters and digits as they are, or in lower case.

    Bytes of characters beyond ASCII count as letters."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if fold and c.isalnum() else b if c.isalnum() else 0
    return table


FOLDED, EXACT = word_table(True), word_table(False)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = FOLDED):
    """``(hashes, start, end, counts)``: each word's hash and byte range, and words per text."""
    n = len(offsets) - 1
    mapped = table[data]
    inside = mapped > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] |= inside[edges]
    at = np.flatnonzero(inside)
    if len(at) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(n, np.int64)
    first = np.flatnonzero(begin[at])
    hashes = run_hashes(mapped[at], first)
    start = at[first]
    end = at[np.append(first[1:], len(at)) - 1] + 1
    counts = np.diff(np.searchsorted(start, offsets))
    return hashes, start, end, counts


def run_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes that begin at ``first``."""
    lengths = np.diff(np.append(first, len(values)))
    place = np.arange(len(values), dtype=np.int64) - np.repeat(first, lengths)
    weights = powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(BYTE_VALUES[values] * weights, first) + lengths.astype(np.uint64)) | _U64(1 << 63)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within each text, and how many each text has.

    A text of fewer words has one shingle of all its words; one of none has none."""
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    total = int(per.sum())
    if total == 0:
        return np.zeros(0, np.uint64), per
    word_at = np.cumsum(counts) - counts
    first = np.repeat(word_at - (np.cumsum(per) - per), per) + np.arange(total)
    stop = np.repeat(word_at + counts, per)
    out = np.zeros(total, np.uint64)
    pw = powers(n + 1)
    for j in range(n):
        k = first + j
        ok = k < stop
        out += np.where(ok, hashes[np.minimum(k, len(hashes) - 1)] * pw[j], _U64(0))
    return mix(out), per


class HashIndex:
    """A map from uint64 hashes to ints for whole arrays of keys: open addressing, linear probing."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * BASE) >> _U64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        mask = len(self.keys) - 1
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((there != keys) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct, nonzero keys."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            full = self.keys != 0
            old = self.keys[full], self.values[full]
            size = len(self.keys)
            while 2 * (self.used + len(keys)) > size:
                size *= 2
            self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int32), 0
            self.add(*old)
        mask = len(self.keys) - 1
        at = self._place(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            todo = todo[~done[todo]]
            at[todo] = np.where(self.keys[at[todo]] != 0, (at[todo] + 1) & mask, at[todo])
        self.used += len(keys)
