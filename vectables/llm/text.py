"""Numpy kernels over whole Arrow text columns: words, word hashes, shingles.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z where ``lower`` says so.
Texts are UTF-8, so byte runs are the words of the text. A word's identity is a 64-bit hash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20   # bytes of text that a kernel holds as 64-bit arrays at once

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the longest run of a base so far is kept."""
    if base not in _KNOWN or len(_KNOWN[base]) < n:
        p = np.full(max(n, 1), base, dtype=np.uint64)
        p[0] = 1
        _KNOWN[base] = np.cumprod(p)
    return _KNOWN[base][:n]


class Texts:
    """The texts of one batch as bytes; null is the empty text."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
        self.offsets = at - at[0]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[at[0]: at[-1]]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(batch: pa.RecordBatch, column: str, most: int = 2 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text, or one longer text."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(
        zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // most + np.arange(len(lengths)) // SET_ROWS * (1 << 40)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Give freed memory back to the machine, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives back what it has freed at the end of a task: it lives on, idle, beside its executor."""

    def kept_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return kept_small


class Words:
    """Words of a batch: byte range, hash and text number of each, and each text's word range."""

    def __init__(self, texts: Texts, lower: bool = True):
        data, offsets = texts.data, texts.offsets
        n = len(data)
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.texts = texts
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)      # text i has words bounds[i]:bounds[i + 1]
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.hash = hash_ranges(data, self.start, self.end, lower)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range ``data[start:end]``; ranges ascend and do not overlap."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(start), dtype=np.uint64)
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(start, start[a] + SLICE_BYTES)))
        base, top = int(start[a]), int(end[b - 1])
        sums = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(table[data[base:top]] * _powers(_STEP, top - base), out=sums[1:])
        s, e = start[a:b] - base, end[a:b] - base
        back = _powers(_BACK, top - base + 1)
        out[a:b] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64))
        a = b
    return out


def kmers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words in one text, and the number of its first word."""
    h = words.hash
    left = np.repeat(words.bounds[1:], words.count) - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    return run_hashes(h, at, k), at


def run_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of k words, given by their hashes, that begins at each of ``at``."""
    scale = _powers(0xD6E8FEB86659FD93, k + 1)
    full = np.full(len(at), np.uint64(k), dtype=np.uint64)
    for j in range(k):
        full += h[at + j] * scale[j + 1]
    return mix(full)


SET_BITS = 52           # a shingle's identity in a set; the bits above it hold the text's number
SET_ROWS = 1 << (64 - SET_BITS)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, flat; and the bounds of each text's part.

    A text with fewer than k words (but any) has its whole sequence as its one shingle. At most
    ``SET_ROWS`` texts at once.
    """
    full, at = kmers(words, k)
    scale = _powers(0xD6E8FEB86659FD93, k + 1)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    part = words.count[short].astype(np.uint64)
    for j in range(k - 1):
        has = words.count[short] > j
        part[has] += words.hash[words.bounds[short[has]] + j] * scale[j + 1]
    h = np.concatenate([full, mix(part)]) >> np.uint64(64 - SET_BITS)
    key = h | (np.concatenate([words.text[at], short]).astype(np.uint64) << np.uint64(SET_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key >> np.uint64(SET_BITS), np.arange(len(words.texts) + 1, dtype=np.uint64))
    return key & np.uint64((1 << SET_BITS) - 1), bounds


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
