"""Byte-level text kernels in numpy, used inside Arrow tasks.

A batch of texts is one byte buffer with offsets; words, hashes and shingles are computed
for many texts at once. Nothing here knows Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit number per byte, for polynomial hashes modulo 2**64.
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time, about 30 bytes of memory each.
STRETCH = 1 << 18
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:  # doubling: the next stretch is this one times base**done
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``limit`` bytes together; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    r"""The words ``[^\x20\x09-\x0D]+`` of texts i..j-1 of a batch; ``gap`` says which bytes lie between words.

    ``start``/``end``: byte places in ``data``; ``first[k]``: index of the first word of text k
    (of those here), with one entry more at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int, lower: bool = True, gap: np.ndarray = IS_SPACE):
        a, b = int(offsets[i]), int(offsets[j])
        own = data[a:b]
        self.data = TO_LOWER[own] if lower else own
        inner = np.zeros(b - a + 2, bool)
        np.logical_not(gap[own], out=inner[1:-1])
        edges = offsets[i : j + 1] - a
        # A word ends where its text ends, also if the next text begins with a word.
        change = inner[1:] != inner[:-1]
        start = np.flatnonzero(change & inner[1:])
        end = np.flatnonzero(change & inner[:-1])
        cut = edges[1:-1]
        cut = np.unique(cut[(cut > 0) & (cut < b - a)])
        cut = cut[inner[cut] & inner[cut + 1]]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, edges, "left")

    def split(self, at: np.ndarray) -> None:
        """Also end a word before each place of ``at`` (ascending) that lies inside one."""
        k = np.searchsorted(self.start, at, "right") - 1
        at = at[(k >= 0) & (at > self.start[np.maximum(k, 0)]) & (at < self.end[np.maximum(k, 0)])]
        edges = np.concatenate([self.start, self.end[-1:]])[self.first]
        self.start, self.end = np.sort(np.concatenate([self.start, at])), np.sort(np.concatenate([self.end, at]))
        self.first = np.searchsorted(self.start, edges, "left")

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, the same for the same bytes everywhere."""
        out = np.zeros(len(self.start), np.uint64)
        k = 0
        while k < len(out):  # runs of words of at most STRETCH bytes, or one longer word
            base = int(self.start[k])
            j = max(k + 1, int(np.searchsorted(self.end, base + STRETCH, "right")))
            start, end = self.start[k:j] - base, self.end[k:j] - base
            n = int(end[-1])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODES[self.data[base : base + n]] * powers(BASE, n), out=sums[1:])
            # The sum over a word, moved to place 0.
            got = (sums[end] - sums[start]) * powers(BASE_INVERSE, n + 1)[start]
            out[k:j] = mix(got ^ (end - start).astype(np.uint64))
            k = j
        return out


_ROLES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of one text's word hashes; a shorter text is one shingle."""
    k = min(width, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for r in range(k):
        out += mix(h[r : r + n] + _ROLES[r]) * _ROLES[r]
    return mix(out)
