"""Hashes of words and byte strings, for whole Arrow batches at once.

Texts of a batch lie side by side as UTF-8 bytes. A running polynomial sum over them gives the
64-bit hash of any stretch from its two ends, so no step loops over words or texts in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(7))
_OF_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0 to n - 1, and its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Stretches:
    """Hashes of stretches of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_OF_BYTE[data] * up[:-1], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _BASE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each text begins (one more for the end)."""
    array = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes together; a longer text is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z in lower case, and the number of its text."""
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) if len(data) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.concatenate([space[1:], [True]]) if len(data) else space
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return Stretches(data).hash(starts, ends), text


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    out = columns[0]
    for c in columns[1:]:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + c)
    return out


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted: hashes, number of the text, and sizes of the sets.

    A text of fewer words than `width` has all its words as one shingle.
    """
    n = len(offsets) - 1
    words, text = word_hashes(data, offsets)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    at = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :]) if len(text) >= width else np.empty(0, np.int64)
    hashes = [fold([words[at + k] for k in range(width)])]
    owners = [text[at]]
    for short in range(1, width):
        which = np.flatnonzero(count == short)
        hashes.append(mix(fold([words[first[which] + k] for k in range(short)]) + np.uint64(short)))
        owners.append(which)
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, owner, np.bincount(owner, minlength=n)
