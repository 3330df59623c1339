"""Words of UTF-8 text as numpy arrays, for use inside tasks.

A batch of texts is one byte buffer plus offsets. Word separators are ASCII in every contract of this subpackage, so words are found and
hashed on bytes, block by block, without a Python object per word. Hashes are 64 bits wide."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_PI, _QI = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_P, _Q))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_PW, _PIW = _powers(_P, BLOCK + 1), _powers(_PI, BLOCK + 1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


SPACES = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null has no bytes."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses an offset."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[buf]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[cuts]
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    ends[cuts] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        b = ends[j - 1]
        size = int(b - a)
        pw, piw = (_PW, _PIW) if size <= BLOCK else (_powers(_P, size + 1), _powers(_PI, size + 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_TABLE[buf[a:b]] * pw[:size], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * piw[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; the caller drops runs that cross a text's end."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    if n == 1:
        return mix(words + np.uint64(1))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= _Q
        out += words[k:len(words) - n + 1 + k]
    return mix(out + np.uint64(n))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cuts a batch so that each piece holds at most `most` bytes of text, or one text."""
    texts = batch.column(column)
    _, offsets = buffers(texts)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def tidy(scan):
    """A `mapInArrow` function that hands freed memory back to the system after its last batch: Spark keeps idle workers, and they keep what
    their allocators hold."""
    def run(batches):
        yield from scan(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return run


def covered(starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Merged [start, end) runs of intervals with ascending starts, as an (n, 2) array."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    ends = np.maximum.accumulate(starts + length)
    first = np.r_[True, starts[1:] > ends[:-1]]
    return np.stack([starts[first], ends[np.r_[np.flatnonzero(first)[1:] - 1, len(starts) - 1]]], 1)


def planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the second lowest, and so on: leading zeros become runs, which shuffles compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(packs: list[bytes], kind: type) -> np.ndarray:
    """The numbers of all packs that `planes` wrote."""
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, len(x) // size).T).view(kind).ravel() for x in packs]
    return np.concatenate(parts) if parts else np.zeros(0, kind)
