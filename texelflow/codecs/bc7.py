"""BC7 blocks of all eight modes to texels, and opaque blocks with two groups of texels.

Blocks of one mode and pattern are read together: their fields are columns of a matrix of bits."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: the group of each of the 16 texels by pattern, for two groups and for three.
GROUPS_2 = (
    "0011001100110011", "0001000100010001", "0111011101110111", "0001001100110111", "0000000100010011", "0011011101111111",
    "0001001101111111", "0000000100110111", "0000000000010011", "0011011111111111", "0000000101111111", "0000000000010111",
    "0001011111111111", "0000000011111111", "0000111111111111", "0000000000001111", "0000100011101111", "0111000100000000",
    "0000000010001110", "0111001100010000", "0011000100000000", "0000100011001110", "0000000010001100", "0111001100110001",
    "0011000100010000", "0000100010001100", "0110011001100110", "0011011001101100", "0001011111101000", "0000111111110000",
    "0111000110001110", "0011100110011100", "0101010101010101", "0000111100001111", "0101101001011010", "0011001111001100",
    "0011110000111100", "0101010110101010", "0110100101101001", "0101101010100101", "0111001111001110", "0001001111001000",
    "0011001001001100", "0011101111011100", "0110100110010110", "0011110011000011", "0110011010011001", "0000011001100000",
    "0100111001000000", "0010011100100000", "0000001001110010", "0000010011100100", "0110110010010011", "0011011011001001",
    "0110001110011100", "0011100111000110", "0110110011001001", "0110001100111001", "0111111010000001", "0001100011100111",
    "0000111100110011", "0011001111110000", "0010001011101110", "0100010001110111",
)
GROUPS_3 = (
    "0011001102212222", "0001001122112221", "0000200122112211", "0222002200110111", "0000000011221122", "0011001100220022",
    "0022002211111111", "0011001122112211", "0000000011112222", "0000111111112222", "0000111122222222", "0012001200120012",
    "0112011201120112", "0122012201220122", "0011011211221222", "0011200122002220", "0001001101121122", "0111001120012200",
    "0000112211221122", "0022002200221111", "0111011102220222", "0001000122212221", "0000001101220122", "0000110022102210",
    "0122012200110000", "0012001211222222", "0110122112210110", "0000011012211221", "0022110211020022", "0110011020022222",
    "0011012201220011", "0000200022112221", "0000000211221222", "0222002200120011", "0011001200220222", "0120012001200120",
    "0000111122220000", "0120120120120120", "0120201212010120", "0011220011220011", "0011112222000011", "0101010122222222",
    "0000000021212121", "0022112200221122", "0022001100220011", "0220122102201221", "0101222222220101", "0000212121212121",
    "0101010101012222", "0222011102220111", "0002111200021112", "0000211221122112", "0222011101110222", "0002111211120002",
    "0110011001102222", "0000000021122112", "0110011022222222", "0022001100110022", "0022112211220022", "0000000000002112",
    "0002000100020001", "0222122202221222", "0101222222222222", "0111201122012220",
)
#: Fixed values of the format: the texel whose highest index bit isn't stored, by pattern: of the second of two groups, and of
#: the second and third of three. That of the first group is texel 0.
ANCHOR_2 = (
    15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 2, 8, 2, 2, 8, 8, 15, 2, 8, 2, 2, 8, 8, 2, 2,
    15, 15, 6, 8, 2, 8, 15, 15, 2, 8, 2, 2, 2, 15, 15, 6, 6, 2, 6, 8, 15, 15, 2, 2, 15, 15, 15, 15, 15, 2, 2, 15,
)
ANCHOR_3_SECOND = (
    3, 3, 15, 15, 8, 3, 15, 15, 8, 8, 6, 6, 6, 5, 3, 3, 3, 3, 8, 15, 3, 3, 6, 10, 5, 8, 8, 6, 8, 5, 15, 15,
    8, 15, 3, 5, 6, 10, 8, 15, 15, 3, 15, 5, 15, 15, 15, 15, 3, 15, 5, 5, 5, 8, 5, 10, 5, 10, 8, 13, 15, 12, 3, 3,
)
ANCHOR_3_THIRD = (
    15, 8, 8, 3, 15, 15, 3, 8, 15, 15, 15, 15, 15, 15, 15, 8, 15, 8, 15, 3, 15, 8, 15, 8, 3, 15, 6, 10, 15, 15, 10, 8,
    15, 3, 15, 10, 10, 8, 9, 10, 6, 15, 8, 15, 3, 6, 6, 8, 15, 3, 15, 15, 15, 15, 15, 15, 15, 15, 15, 15, 3, 15, 15, 8,
)
#: Weights of 64 by the width of an index.
WEIGHTS = {2: (0, 21, 43, 64), 3: (0, 9, 18, 27, 37, 46, 55, 64), 4: (0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64)}


@dataclass(frozen=True)
class Mode:
    groups: int
    pattern: int  # bits of the pattern, of the channel that alpha changes place with, and of which index is colour's
    rotation: int
    choice: int
    colour: int  # bits of an end point's channels
    alpha: int
    lowest: int  # shared lowest bits: 0 none, 1 one a group, 2 one an end point
    index: int
    second: int  # bits of alpha's own index


#: Fixed values of the format.
MODES = (
    Mode(3, 4, 0, 0, 4, 0, 2, 3, 0), Mode(2, 6, 0, 0, 6, 0, 1, 3, 0), Mode(3, 6, 0, 0, 5, 0, 0, 2, 0), Mode(2, 6, 0, 0, 7, 0, 2, 2, 0),
    Mode(1, 0, 2, 1, 5, 6, 0, 2, 3), Mode(1, 0, 2, 0, 7, 8, 0, 2, 2), Mode(1, 0, 0, 0, 7, 7, 2, 4, 0), Mode(2, 6, 0, 0, 5, 5, 2, 2, 0),
)


@functools.cache
def layout(groups: int, pattern: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """(group of each texel, texels without a highest index bit)."""
    if groups == 1:
        return np.zeros(16, np.int64), (0,)
    text = (GROUPS_2 if groups == 2 else GROUPS_3)[pattern]
    anchors = (0, ANCHOR_2[pattern]) if groups == 2 else (0, ANCHOR_3_SECOND[pattern], ANCHOR_3_THIRD[pattern])
    return np.array([int(c) for c in text]), anchors


class _Reader:
    """Fields of many blocks (n, 128), lowest bit first."""

    def __init__(self, bits: np.ndarray, at: int):
        self.bits, self.at = bits, at

    def take(self, n: int) -> np.ndarray:
        out = self.bits[:, self.at : self.at + n] @ (1 << np.arange(n)) if n else np.zeros(len(self.bits), np.int64)
        self.at += n
        return out

    def indexes(self, size: int, anchors: tuple[int, ...]) -> np.ndarray:
        return np.stack([self.take(size - (t in anchors)) for t in range(16)], axis=1)


def _widened(v: np.ndarray, n: int) -> np.ndarray:
    """n bits, 4 at least, replicated to 8."""
    return v << (8 - n) | v >> (2 * n - 8)


def _decoded(bits: np.ndarray, mode: int, pattern: int) -> np.ndarray:
    m = MODES[mode]
    group, anchors = layout(m.groups, pattern)
    r = _Reader(bits, mode + 1 + m.pattern)
    rotation, choice = r.take(m.rotation), r.take(m.choice)
    sizes = [m.colour] * 3 + ([m.alpha] if m.alpha else [])
    ends = np.stack([np.stack([np.stack([r.take(n), r.take(n)], 1) for _ in range(m.groups)], 1) for n in sizes], axis=3)  # blocks, groups, 2, channels
    if m.lowest:
        low = np.stack([r.take(1) for _ in range(m.groups * m.lowest)], 1).reshape(len(bits), m.groups, m.lowest, 1)
        ends, sizes = ends << 1 | low, [n + 1 for n in sizes]
    wide = np.full((len(bits), m.groups, 2, 4), 255)
    for c, n in enumerate(sizes):
        wide[..., c] = _widened(ends[..., c], n)
    first = r.indexes(m.index, anchors)
    w = np.array(WEIGHTS[m.index])[first]
    own = np.repeat(w[:, :, None], 4, axis=2)
    if m.second:
        v = np.array(WEIGHTS[m.second])[r.indexes(m.second, anchors)]
        swapped = (choice == 1)[:, None]
        own[..., :3], own[..., 3] = np.where(swapped, v, w)[:, :, None], np.where(swapped, w, v)
    lo, hi = wide[:, group, 0], wide[:, group, 1]
    out = (lo * (64 - own) + hi * own + 32) >> 6
    for c in range(3):
        here = rotation == c + 1
        out[here, :, c], out[here, :, 3] = out[here, :, 3].copy(), out[here, :, c].copy()
    return out


def texels(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 4) RGBA of blocks (n, 16); a block without a mode is an error."""
    bits = np.unpackbits(blocks, axis=1, bitorder="little").astype(np.int64)
    if not bits[:, :8].any(1).all():
        raise ValueError("invalid BC7 mode")
    modes = bits[:, :8].argmax(1) if len(bits) else np.zeros(0, np.int64)
    out = np.zeros((len(blocks), 16, 4), np.uint8)
    for mode in np.unique(modes):
        here = np.flatnonzero(modes == mode)
        n = MODES[mode].pattern
        patterns = bits[here, mode + 1 : mode + 1 + n] @ (1 << np.arange(n)) if n else np.zeros(len(here), np.int64)
        for p in np.unique(patterns):
            own = here[patterns == p]
            out[own] = _decoded(bits[own], int(mode), int(p))
    return out


# ---- opaque blocks with two groups (mode 1)

TWO = 1
#: Patterns whose fit is worked out in full, of those with the least spread around their groups' axes.
TRIED = 4


def best_patterns(rgb: np.ndarray, most: int = TRIED) -> np.ndarray:
    """(n, most) patterns of two groups with the least squared distance from each group's principal axis."""
    spread = np.zeros((len(rgb), len(GROUPS_2)))
    for p in range(len(GROUPS_2)):
        group, _ = layout(2, p)
        for g in (0, 1):
            v = rgb[:, group == g]
            off = v - v.mean(1, keepdims=True)
            power = np.linalg.eigvalsh(np.einsum("nic,nid->ncd", off, off))
            spread[:, p] += power[:, :2].sum(1)  # all but the axis
    return np.argsort(spread, axis=1, kind="stable")[:, :most]


def _group_fit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error, codes (n, 2, 4: r, g, b and the shared lowest bit), indexes) of texels (n, k, 3) of one group."""
    from .bc import _ends, _least_squares, distances

    w = np.array(WEIGHTS[3])

    def chosen(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        best = None
        for low in (0, 1):
            code = np.stack([np.clip(np.floor((e * 127 / 255 - low) / 2 + 0.5), 0, 63).astype(np.int64) for e in (first, second)], 1)
            wide = _widened(code << 1 | low, 7)
            tones = (wide[:, :1] * (64 - w[None, :, None]) + wide[:, 1:] * w[None, :, None] + 32) >> 6
            off = distances(v, tones)
            error, index = off.min(2).sum(1), off.argmin(2)
            full = np.concatenate([code, np.full((len(v), 2, 1), low)], 2)
            if best is None:
                best = error, full, index
            else:
                better = error < best[0]
                best = np.where(better, error, best[0]), np.where(better[:, None, None], full, best[1]), np.where(better[:, None], index, best[2])
        return best

    error, codes, index = chosen(*_ends(v))
    there, first, second = _least_squares(v, w[index] / 64)
    again = chosen(first, second)
    better = there & (again[0] < error)
    return np.where(better, again[0], error), np.where(better[:, None, None], again[1], codes), np.where(better[:, None], again[2], index)


def two_groups(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(error, (n, 16) bytes) of the best of a few patterns for texels (n, 16, 3)."""
    v = rgb.astype(np.float64)
    error, out = np.full(len(v), np.inf), np.zeros((len(v), 16), np.uint8)
    tried = best_patterns(v)
    for p in np.unique(tried):
        here = np.flatnonzero((tried == p).any(1))
        group, anchors = layout(2, int(p))
        fits = [_group_fit(v[here][:, group == g]) for g in (0, 1)]
        total = fits[0][0] + fits[1][0]
        better = total < error[here]
        if better.any():
            own = here[better]
            error[own] = total[better]
            out[own] = _written(int(p), group, anchors, [(f[1][better], f[2][better]) for f in fits])
    return error, out


def _written(pattern: int, group: np.ndarray, anchors: tuple[int, ...], fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n = len(fits[0][0])
    index, codes = np.zeros((n, 16), np.int64), []
    for g, (code, own) in enumerate(fits):
        index[:, group == g] = own
        turn = index[:, anchors[g]] > 3  # its highest bit isn't stored
        index[:, group == g] = np.where(turn[:, None], 7 - own, own)
        codes.append(np.where(turn[:, None, None], code[:, ::-1], code))
    m = MODES[TWO]
    fields = [(np.full(n, 1 << TWO), TWO + 1), (np.full(n, pattern), m.pattern)]
    fields += [(codes[g][:, k, c], m.colour) for c in range(3) for g in (0, 1) for k in (0, 1)]
    fields += [(codes[g][:, 0, 3], 1) for g in (0, 1)]
    fields += [(index[:, t], m.index - (t in anchors)) for t in range(16)]
    bits, at = np.zeros((n, 128), np.uint8), 0
    for value, size in fields:
        bits[:, at : at + size] = value[:, None] >> np.arange(size) & 1
        at += size
    return np.packbits(bits, axis=1, bitorder="little")
