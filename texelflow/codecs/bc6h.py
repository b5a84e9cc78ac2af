"""Unsigned BC6H blocks of half floats, all blocks at once, and their texels.

One mode is written: one pair of end points of ten bits a channel and sixteen steps between them. End points lie on
the principal axis of a block's texels, then move to the least squares of the steps chosen; what has the lesser error
stays. Distances are those of the halves' bit patterns, which grow with the logarithm of the value."""

from __future__ import annotations

import numpy as np

from .bc import BC7_WEIGHTS, distances

#: Fixed values of the format: the mode's bits, the end points' width, the greatest half.
MODE, MODE_BITS, WIDTH, MOST = 0x03, 5, 10, 0x7BFF


def sound(halves: np.ndarray) -> np.ndarray:
    """Bit patterns that the format can hold: negative ones and not-a-number are 0, infinity is the greatest half."""
    h = halves.astype(np.int64)
    return np.where((h >= 0x8000) | (h > 0x7C00), 0, np.minimum(h, MOST))


def _widened(code: np.ndarray) -> np.ndarray:
    """Codes of ten bits on the scale of sixteen."""
    return np.where(code == 0, 0, np.where(code == (1 << WIDTH) - 1, 0xFFFF, (code << 6) + 32))


def _steps(ends: np.ndarray) -> np.ndarray:
    """(n, 16, 3) halves between code pairs (n, 2, 3)."""
    wide = _widened(ends)
    w = BC7_WEIGHTS[None, :, None]
    return (((wide[:, :1] * (64 - w) + wide[:, 1:] * w + 32) >> 6) * 31) >> 6


def _codes(halves: np.ndarray) -> np.ndarray:
    """Codes whose widened value gives about these halves."""
    return np.clip(np.floor((halves * 64 / 31 - 32) / 64 + 0.5), 0, (1 << WIDTH) - 1).astype(np.int64)


def _choice(v: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(error, codes, steps) of pairs of halves (n, 2, 3)."""
    codes = _codes(ends)
    off = distances(v, _steps(codes))
    return off.min(2).sum(1), codes, off.argmin(2)


def _fitted(v: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether there is one, and the pair of ends (n, 2, 3) that fits the texels best with these steps."""
    b = BC7_WEIGHTS[steps] / 64
    a = 1 - b
    aa, ab, bb = (a * a).sum(1), (a * b).sum(1), (b * b).sum(1)
    det = aa * bb - ab * ab
    there = det > 1e-9
    va, vb = np.einsum("ni,nic->nc", a, v), np.einsum("ni,nic->nc", b, v)
    d = np.where(there, det, 1)[:, None]
    pair = np.stack([(va * bb[:, None] - vb * ab[:, None]) / d, (vb * aa[:, None] - va * ab[:, None]) / d], axis=1)
    return there, np.clip(pair, 0, MOST)


def pack(halves: np.ndarray) -> np.ndarray:
    """(n, 16) bytes of texels (n, 16, 3)."""
    v = sound(halves).astype(np.float64)
    off = v - v.mean(1, keepdims=True)
    axis = np.linalg.eigh(np.einsum("nic,nid->ncd", off, off))[1][:, :, -1]
    along = np.einsum("nic,nc->ni", off, axis)
    rows = np.arange(len(v))
    error, codes, steps = _choice(v, np.stack([v[rows, along.argmin(1)], v[rows, along.argmax(1)]], axis=1))
    for _ in range(2):
        there, ends = _fitted(v, steps)
        e, c, s = _choice(v, ends)
        better = there & (e < error)
        error, codes, steps = np.where(better, e, error), np.where(better[:, None, None], c, codes), np.where(better[:, None], s, steps)
    turn = steps[:, 0] > 7  # the first texel's highest bit isn't stored
    codes, steps = np.where(turn[:, None, None], codes[:, ::-1], codes), np.where(turn[:, None], 15 - steps, steps)
    bits = np.zeros((len(v), 128), np.uint8)
    at = 0
    fields = [(np.full(len(v), MODE), MODE_BITS), *((codes[:, k, c], WIDTH) for k in (0, 1) for c in range(3)), (steps[:, 0], 3), *((steps[:, t], 4) for t in range(1, 16))]
    for value, size in fields:
        bits[:, at : at + size] = value[:, None] >> np.arange(size) & 1
        at += size
    return np.packbits(bits, axis=1, bitorder="little")


def texels(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 3) halves of blocks in the mode written here; others are an error."""
    bits = np.unpackbits(blocks, axis=1, bitorder="little").astype(np.int64)
    take = lambda at, n: bits[:, at : at + n] @ (1 << np.arange(n))
    if (take(0, MODE_BITS) != MODE).any():
        raise ValueError("only one BC6H mode is read")
    codes = np.stack([np.stack([take(MODE_BITS + WIDTH * (3 * k + c), WIDTH) for c in range(3)], axis=1) for k in (0, 1)], axis=1)
    start = MODE_BITS + 6 * WIDTH
    steps = np.stack([take(start, 3), *(take(start + 3 + 4 * t, 4) for t in range(15))], axis=1)
    return np.take_along_axis(_steps(codes), steps[:, :, None], 1)


#: Blocks packed at a time.
CHUNK = 4096


def image(rgb: np.ndarray) -> bytes:
    """Blocks of an image (height, width, 3) of halves; edge blocks repeat the last row and column."""
    h, w = rgb.shape[:2]
    padded = np.pad(rgb, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    v = padded.reshape(padded.shape[0] // 4, 4, -1, 4, 3).transpose(0, 2, 1, 3, 4).reshape(-1, 16, 3)
    return b"".join(pack(v[k : k + CHUNK]).tobytes() for k in range(0, len(v), CHUNK))
