"""Sorted runs of byte strings with front coding, and a loser tree that merges them by known common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are equal and aren't looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[bytes, bytes]:
    """(prefix and rest lengths, rests) of sorted strings."""
    sizes, rests, last = np.zeros((len(strings), 2), np.int32), [], b""
    for k, s in enumerate(strings):
        h = common_prefix(last, s)
        sizes[k] = h, len(s) - h
        rests.append(s[h:])
        last = s
    return sizes.tobytes(), b"".join(rests)


def decoded(sizes: bytes, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, common prefix with the one before)."""
    last, at = b"", 0
    for h, n in np.frombuffer(sizes, np.int32).reshape(-1, 2).tolist():
        last = last[:h] + rests[at : at + n]
        at += n
        yield last, h


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """(string, run, common prefix with the string before) of all runs in order.

    Each entry carries its common prefix with the last winner. Of two entries the one with the longer prefix is
    the smaller; only if the prefixes are equal, bytes after them are compared."""
    width = 1 << max(0, (len(runs) - 1).bit_length())
    string: list[bytes | None] = [None] * width  # None: the run has ended; it loses to all
    prefix = [0] * width

    def advance(r: int) -> None:
        string[r], prefix[r] = next(runs[r], (None, 0)) if r < len(runs) else (None, 0)

    def beats(c: int, o: int) -> bool:
        """Whether c stays ahead of o; the loser's prefix becomes that with the winner."""
        a, b = string[c], string[o]
        if a is None or b is None:
            return a is not None
        if prefix[c] != prefix[o]:
            return prefix[c] > prefix[o]
        h = common_prefix(a, b, prefix[c])
        if a[h:] <= b[h:]:
            prefix[o] = h
            return True
        prefix[c] = h
        return False

    for r in range(width):
        advance(r)
        prefix[r] = 0
    loser = [0] * width
    winners = list(range(width))
    at = width
    while len(winners) > 1:  # play the first round, level by level
        at //= 2
        up = []
        for k in range(at):
            a, b = winners[2 * k], winners[2 * k + 1]
            won = beats(a, b)
            loser[at + k] = b if won else a
            up.append(a if won else b)
        winners = up
    best = winners[0]
    while string[best] is not None:
        yield string[best], best, prefix[best]
        advance(best)
        node = (best + width) // 2
        while node:
            if not beats(best, loser[node]):
                best, loser[node] = loser[node], best
            node //= 2
