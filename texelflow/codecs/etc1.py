"""ETC1 blocks: of palette entries without loss, of texels by search; and their texels.

A block is 64 bits, highest first: base colours, two tables of modifiers, a bit for differential colours, a bit for
halves that lie on top of each other, then two planes of 16 bits, texels column by column."""

from __future__ import annotations

import numpy as np

from ..functions.pixels import ETC1_MODIFIERS
from .bc import distances

MODIFIERS = np.array(ETC1_MODIFIERS)
#: The two bits of a selector, least modifier first.
CODES = np.array((3, 2, 0, 1))
#: Place of a texel, row by row, in a plane.
PLACE = np.arange(16) % 4 * 4 + np.arange(16) // 4
#: Half of each texel: side by side, on top of each other.
HALVES = (np.arange(16) % 4 // 2, np.arange(16) // 8)


def _bytes(head: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """(n, 8) bytes of the high 32 bits and the selectors (n, 16)."""
    code = CODES[selectors]
    low = ((code >> 1) << (16 + PLACE)).sum(1) | ((code & 1) << PLACE).sum(1)
    return (head << 32 | low).astype(">u8").view(np.uint8).reshape(-1, 8)


def of_palette(ends: np.ndarray, selectors: np.ndarray) -> np.ndarray:
    """(n, 8) bytes: differential blocks whose halves are the same. ends (n, 4): r, g, b of 5 bits and the table."""
    r, g, b, table = (ends[:, k].astype(np.int64) for k in range(4))
    return _bytes(r << 27 | g << 19 | b << 11 | table << 5 | table << 2 | 2, selectors)


def _wide(v: np.ndarray, bits: int) -> np.ndarray:
    return v << 3 | v >> 2 if bits == 5 else v * 17


def _narrow(mean: np.ndarray, bits: int) -> np.ndarray:
    most = (1 << bits) - 1
    return np.clip(np.floor(mean * most / 255 + 0.5), 0, most).astype(np.int64)


def _fit(half: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error, table, selectors (n, 8)) of the best table for texels (n, 8, 3) about base (n, 3)."""
    best = None
    for t, row in enumerate(MODIFIERS):
        tone = np.clip(base[:, None, :] + row[None, :, None], 0, 255)  # n, 4, 3
        off = distances(half, tone)
        selector = off.argmin(2)
        error = off.min(2).sum(1)
        if best is None:
            best = error, np.zeros(len(half), np.int64), selector
        else:
            better = error < best[0]
            best = np.where(better, error, best[0]), np.where(better, t, best[1]), np.where(better[:, None], selector, best[2])
    return best


def _half(half: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(error, colour, table, selectors): about the mean, then about the mean less the modifiers chosen."""
    mean = half.mean(1)
    colour = _narrow(mean, bits)
    error, table, selector = _fit(half, _wide(colour, bits))
    moved = _narrow(mean - np.take_along_axis(MODIFIERS[table], selector, 1).mean(1)[:, None], bits)
    again = _fit(half, _wide(moved, bits))
    better = again[0] < error
    return np.where(better, again[0], error), np.where(better[:, None], moved, colour), np.where(better, again[1], table), np.where(better[:, None], again[2], selector)


def pack(rgb: np.ndarray) -> np.ndarray:
    """(n, 8) bytes of texels (n, 16, 3): the least error of both splits, of colours of 4 bits each and of 5 bits that
    are near each other."""
    rgb = rgb.astype(np.int64)
    least = out = None
    for flip, side in enumerate(HALVES):
        for bits in (4, 5):
            parts = [_half(rgb[:, side == k], bits) for k in (0, 1)]
            (e0, c0, t0, s0), (e1, c1, t1, s1) = parts
            if bits == 5:
                delta = c1 - c0
                near = (delta >= -4) & (delta <= 3)
                if not near.all():  # the second colour comes as near as it can
                    c1 = c0 + np.clip(delta, -4, 3)
                    forced = _fit(rgb[:, side == 1], _wide(c1, 5))
                    far = ~near.all(1)
                    e1, t1, s1 = np.where(far, forced[0], e1), np.where(far, forced[1], t1), np.where(far[:, None], forced[2], s1)
                colour = [c0[:, k] << 3 | (c1 - c0)[:, k] & 7 for k in range(3)]
            else:
                colour = [c0[:, k] << 4 | c1[:, k] for k in range(3)]
            selectors = np.zeros((len(rgb), 16), np.int64)
            selectors[:, side == 0], selectors[:, side == 1] = s0, s1
            block = _bytes(colour[0] << 24 | colour[1] << 16 | colour[2] << 8 | t0 << 5 | t1 << 2 | (bits == 5) << 1 | flip, selectors)
            error = e0 + e1
            if least is None:
                least, out = error, block
            else:
                better = error < least
                least, out = np.where(better, error, least), np.where(better[:, None], block, out)
    return out


def texels(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 3) of blocks (n, 8)."""
    word = np.ascontiguousarray(blocks).view(">u8").reshape(-1).astype(np.uint64)
    take = lambda at, n: (word >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64)
    differs, flip = take(33, 1), take(32, 1)
    base = np.zeros((2, len(word), 3), np.int64)
    for c in range(3):
        at = 56 - 8 * c
        first, delta = take(at + 3, 5), (take(at, 3) ^ 4) - 4
        base[0, :, c] = np.where(differs, _wide(first, 5), _wide(take(at + 4, 4), 4))
        base[1, :, c] = np.where(differs, _wide(first + delta, 5), _wide(take(at, 4), 4))
    tables = np.stack([take(37, 3), take(34, 3)])
    side = np.where(flip[:, None], HALVES[1], HALVES[0])
    code = np.stack([take(16 + int(p), 1) << 1 | take(int(p), 1) for p in PLACE], axis=1)
    selector = np.argsort(CODES)[code]
    rows = np.arange(len(word))[:, None]
    return np.clip(base[side, rows] + MODIFIERS[tables[side, rows], selector][..., None], 0, 255).astype(np.uint8)
