"""Vectorised text kernels on Arrow string columns: words and shingles as hashes.

All work on the UTF-8 buffers of a batch at once, in blocks of bounded
size, without making Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts handled at once, unless one text is longer.
BLOCK = 1 << 18
#: Bytes whose words are hashed at once, unless one word is longer.
CHUNK = 1 << 16
SHINGLE = 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_COEF = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.cumprod(row))
    return out[0], out[1]


_KNOWN = _powers(2 * CHUNK)


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def substrings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each part of `data`; A-Z count as a-z.  Starts and ends ascend."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        low = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        size = int(ends[b - 1] - low)
        up, down = _KNOWN if size < len(_KNOWN[0]) else _powers(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[data[low : low + size]]] * up[:size], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        out[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def blocks(offsets: np.ndarray, most: int = BLOCK, texts: int = 1 << 12) -> Iterator[tuple[int, int]]:
    """Ranges of at most `texts` texts of up to `most` bytes together, or one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(a + texts, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, min(b, n)
        a = min(b, n)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of `inside` bytes, which end where a text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    return starts, np.flatnonzero(inside & (~after | first[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each text's first word (n + 1 values).

    `inside` tells for each byte whether words hold it; by default they
    are divided by white space.  A-Z count as a-z.  Words also end and
    begin at `cuts`, positions in or beside words.
    """
    starts, ends = spans(data, offsets, inside[data])
    if cuts is not None and len(cuts):
        cuts = np.setdiff1d(cuts, np.union1d(starts, ends))
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    return substrings(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each run of `n` words; a shorter text is one run."""
    total = len(hashes)
    counts = np.diff(firsts)
    end = np.repeat(firsts[1:], counts)
    at = np.arange(total)
    short = (np.repeat(counts, counts) < n) & (at == np.repeat(firsts[:-1], counts))
    out = hashes * _COEF[0]
    for j in range(1, min(n, total)):
        more = np.zeros(total, np.uint64)
        more[: total - j] = hashes[j:] * _COEF[j]
        out += np.where(at + j < end, more, np.uint64(0))
    keep = np.flatnonzero((at + n <= end) | short)
    return mix(out[keep]), keep
