"""Vectorised hashing of words: many texts at a time, whole texts, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x100000001B3)
_POW = np.cumprod(np.append(np.uint64(1), np.full(63, _BASE)))
_SPACE = np.zeros(256, np.uint8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and all of multi-byte characters, 2 other signs
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[_SPACE == 1] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grouped(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) of runs of about `most` bytes, to bound the arrays."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        b = t.encode()
        if run and size + len(b) > most:
            yield first, run
            first, run, size = k, [], 0
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def words(run: list[bytes], signs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per text the place of its first word, with the end as last entry.

    signs: words are runs of letters and digits or runs of other signs; else whatever white space parts.
    A-Z count as lower case. Texts are joined by a line feed, so no word spans two."""
    raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    ends = np.cumsum([len(b) + 1 for b in run])
    kind = _CLASS[raw] if signs else 1 - _SPACE[raw]
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    starts = np.flatnonzero(change & (kind != 0))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(run) + 1, np.int64)
    edges = np.flatnonzero(change)
    after = np.append(edges, len(raw))[np.searchsorted(edges, starts) + 1]
    offset = np.arange(len(raw)) - np.repeat(np.append(edges, len(raw))[:-1], np.diff(np.append(edges, len(raw))))
    value = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _POW[offset & 63] * (kind != 0)
    if (after - starts).max() > 64:
        value += (offset >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * value
    hashes = mix(np.add.reduceat(value, starts) + (after - starts).astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` following words; shorter input gives one shingle of what there is, empty input none."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n - size + 1 + j]
    return mix(out)
