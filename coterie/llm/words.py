"""Hashes of whole texts' words, computed over slices of bytes with numpy.

A word is a run of bytes of a class, as the classes in use take every byte above
0x7F. A word's 64-bit hash is a polynomial over its bytes, read off running sums,
then mixed together with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes of a word between white space, and of letters and digits.
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of a hash depends on all."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed_words(texts: pa.Array, of_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: index of the first text, word bounds per text, word hashes.

    Text `first + k` has the hashes from `bounds[k]` to `bounds[k + 1]`. A-Z count as a-z;
    a null text has no words.
    """
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer and data_buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, *_slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], of_word)
        first = last


def _slice(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = of_word[data]
    left, right = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    left[1:], right[:n] = inside, inside
    left[offsets] = False  # no word runs from one text into the next
    right[offsets] = False
    starts = np.flatnonzero(inside & ~left[:n])
    ends = np.flatnonzero(inside & ~right[1:]) + 1
    return np.searchsorted(starts, offsets), hashes_of(data, starts, ends)


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of some bytes; A-Z count as a-z."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * _power(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words each, by the place of the first."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[j : j + n]
    return mixed(out)
