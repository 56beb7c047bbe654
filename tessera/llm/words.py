"""Words of UTF-8 texts as numpy arrays of byte offsets and 64-bit digests.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which is what the
pattern ``[^\\x20\\x09-\\x0D]+`` matches. Work goes over slices of an Arrow
batch of about ``SLICE_BYTES`` so that a task's memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240611)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _LETTER.copy()
_LOWERED[65:91] = _LETTER[97:123]
_places = np.ones(1, np.uint64)


def places(n: int) -> np.ndarray:
    """The first n of a fixed row of unrelated odd numbers, one for each place in a
    word. (Powers of one base won't do: modulo 2**64 some words of a few hundred letters
    have the digest of others, whatever the base.)"""
    global _places
    if len(_places) < n:
        size = max(n, 2 * len(_places), 1024)
        _places = mix((np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C13)) | np.uint64(1)
    return _places[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The digest of an ordered pair of digests."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray, lower: bool = False) -> np.ndarray:
    """A digest of each byte span; spans are in order, not empty and don't
    overlap; inside marks the bytes that belong to spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = int(starts[0])
    data, inside, steps = data[first:], inside[first:], np.diff(starts, append=len(data))
    place = np.arange(len(data), dtype=np.int32) - np.repeat((starts - first).astype(np.int32), steps)
    letters = (_LOWERED if lower else _LETTER)[data]
    letters *= places(int(steps.max()) + 1)[place]
    letters *= inside
    return mix(np.add.reduceat(letters, starts - first) + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


@dataclass
class Slice:
    """Rows first..last of a batch: their bytes, and the words in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # of the rows in data
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    words: np.ndarray  # of each row, offsets into starts
    inside: np.ndarray  # whether a byte belongs to a word

    def digests(self, lower: bool = False) -> np.ndarray:
        return span_digests(self.data, self.starts, self.ends, self.inside, lower)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The words of all texts, by slices of whole rows; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        data, own = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        # a word also ends where its row ends
        word = ~_SPACE[data]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        inner = own[(own > 0) & (own < len(data))]
        opens[inner] = word[inner]
        starts = np.flatnonzero(opens)
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        closes[inner - 1] = word[inner - 1]
        ends = np.flatnonzero(closes) + 1
        yield Slice(first, last, data, own, starts, ends, np.searchsorted(starts, own), word)
        first = last


def windows(digests: np.ndarray, width: int) -> np.ndarray:
    """A digest of every run of width digests, in order."""
    n = len(digests) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + digests[i : i + n]
    return mix(out)
