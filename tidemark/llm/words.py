"""Vectorised words, word windows and their hashes over many texts at a time.

A chunk of texts is one byte buffer. A word's hash is a polynomial over random
64-bit codes of its bytes, so that one running sum gives all words at once; a
window's hash is the same over its words. Hashes are 64 bits wide: equal
sequences always agree, unequal ones agree once in about 2**64 pairs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK_BYTES = 1 << 19
#: tables of powers beyond this length are not kept
MOST_KEPT = CHUNK_BYTES * 2
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: ASCII other than digits and letters
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of base and of its inverse; a few lengths only, so that a worker keeps few tables."""
    return _power_table(base, MOST_KEPT) if n <= MOST_KEPT else _power_table.__wrapped__(base, n)


@lru_cache(maxsize=4)
def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


@dataclass
class Words:
    """The words of a chunk. Document i of the chunk has the words first[i]:first[i + 1]."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie within one document."""
        n = len(self.code)
        if n < k:
            return np.zeros(n, np.uint64), np.zeros(n, bool)
        up, down = _powers(_Q, n + 1)
        run = _running(self.code * up[:n])
        out = np.zeros(n, np.uint64)
        out[: n - k + 1] = mix((run[k:] - run[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))
        last = np.repeat(self.first[1:], np.diff(self.first))
        return out, np.arange(n) + k <= last

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A code of the words from each start to its end."""
        up, down = _powers(_Q, len(self.code) + 1)
        run = _running(self.code * up[: len(self.code)])
        return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]]


def codes_between(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code of the bytes from each start to its end."""
    n = len(data)
    up, down = _powers(_P, n + 1)
    run = _running(_codes()[data] * up[:n])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def words(raw: list[bytes], between: bytes = WHITE, fold: bool = False) -> Words:
    """between: the bytes that part words. fold: A-Z count as a-z in codes, not in text()."""
    buf = b" ".join(raw) + b" "
    table = np.zeros(256, bool)
    table[list(between)] = True
    codes = _codes().copy()
    if fold:
        codes[65:91] = codes[97:123]
        table[65:91] = table[97:123]
    data = np.frombuffer(buf, np.uint8)
    inside = ~table[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    n = len(data)
    up, down = _powers(_P, n + 1)
    run = _running(codes[data] * up[:n])
    code = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    return Words(buf, start, end, np.searchsorted(start, at), code)


def release() -> None:
    """Gives memory that a task has freed back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about so many bytes of text each; a longer text is a chunk of its own. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at), [x or b"" for x in batch.column(column).slice(at, to - at).cast(pa.large_binary()).to_pylist()]
            at = to
    release()
