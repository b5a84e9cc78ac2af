"""Content-defined anchors of byte strings: every window of WINDOW bytes names the place in it, among those of
its grams, with the least hash. Equal windows name the same place, so windows only need to be compared within
the same gram; following windows of one anchor form a stretch.

Grams known to be common come last in every window's choice, so that a window names one only if all its grams
are common. Equal windows hold the same grams, so they still name the same place."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from .text_hash import mix

GRAM = 56
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = np.uint64((1 << 24) - 1)
_COMMON = np.uint64(1 << 63)
#: Bytes hashed at once; places fit in 24 bits.
CHUNK = 1 << 20
NONE = np.zeros(0, np.int64)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (_BASE, inverse))  # type: ignore[return-value]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each full window: from block-wise running minima of both directions."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).reshape(-1)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


class Common:
    """Membership in a list of grams: a table of their low bits first, as most grams aren't in it."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(np.asarray(grams, np.int64))
        self.low = np.zeros(1 << 20, bool)
        self.low[self.grams & 0xFFFFF] = True

    def holds(self, grams: np.ndarray) -> np.ndarray:
        out = self.low[grams & 0xFFFFF]
        at = np.flatnonzero(out)
        out[at] = np.isin(grams[at], self.grams)
        return out


def stretches(texts: list[bytes], window: int, common: Common | None = None) -> dict[str, np.ndarray]:
    """text (index), a, b (first and last window start in it), p (anchor), gram (hash), moved (whether any of its
    windows would name another place if no gram were common)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) > _PLACE:
        raise ValueError("too many bytes at once; cut the text into parts that overlap")
    empty = dict.fromkeys(("text", "a", "b", "p", "gram"), NONE) | {"moved": np.zeros(0, bool)}
    if len(raw) < window:
        return empty
    ends = np.cumsum(sizes)
    n = len(raw)
    up, down = _powers(1 << (n - 1).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    owner = np.repeat(np.arange(len(texts)), sizes)[: n - window + 1]
    starts = np.flatnonzero(np.arange(len(owner)) + window <= ends[owner])
    if not len(starts):
        return empty
    order = (gram >> np.uint64(1) & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    plain = (_sliding_min(order, window - GRAM + 1) & _PLACE).astype(np.int64)[starts]
    at = plain
    if common is not None and len(common.grams) and common.holds(gram[plain].view(np.int64)).any():
        order |= np.where(common.holds(gram.view(np.int64)), _COMMON, np.uint64(0))
        at = (_sliding_min(order, window - GRAM + 1) & _PLACE).astype(np.int64)[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    a, b, p = starts[first], starts[last], at[first]
    text = owner[a]
    begin = ends[text] - sizes[text]
    return {"text": text, "a": a - begin, "b": b - begin, "p": p - begin, "gram": gram[p].view(np.int64), "moved": np.logical_or.reduceat(at != plain, first)}


def of_all(texts: list[bytes], window: int, common: Common | None = None) -> Iterator[dict[str, np.ndarray]]:
    """stretches() of texts of any length, run by run; text is the place in `texts`."""
    for index, run in chunks(texts):
        if len(run[0]) <= _PLACE >> np.uint64(1):
            found = stretches(run, window, common)
            yield found | {"text": np.asarray(index)[found["text"]]}
            continue
        step = int(_PLACE >> np.uint64(2))  # parts share window - 1 bytes, so each window lies in one part alone
        for at in range(0, len(run[0]) - window + 1, step):
            found = stretches([run[0][at : at + step + window - 1]], window, common)
            yield found | {k: found[k] + at for k in ("a", "b", "p")} | {"text": np.full(len(found["a"]), index[0])}


def chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(indexes, texts) of at most about CHUNK bytes together; a longer text is alone."""
    index, run, size = [], [], 0
    for k, t in enumerate(texts):
        if run and size + len(t) > CHUNK:
            yield index, run
            index, run, size = [], [], 0
        index.append(k)
        run.append(t)
        size += len(t)
    if run:
        yield index, run
