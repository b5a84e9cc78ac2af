"""Weight grids coded by a cosine transform: a mean, then coefficients with runs of zeros in diagonal order, in steps
that grow with frequency and shrink with quality and with the span of the block's end points."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from . import astc_hdr
from .xuastc import Decoder, SymbolModel

#: The steps of JPEG's luminance table with a first entry of 4, and the symbol that ends a plane.
STEPS = (
    (4, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
LAST, LEAST_SPAN = 64, 14.0


@functools.cache
def diagonal(width: int, height: int) -> tuple[tuple[int, int], ...]:
    """(x, y) of a grid along its diagonals, every other one upwards."""
    cells = [(x, y) for y in range(height) for x in range(width)]
    return tuple(sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 == 0 else -c[0])))


def mean_scale(weight_range: int) -> float:
    """Symbols a unit of the mean weight: coarse where weights are."""
    return 1 / 8 if weight_range <= 5 else 1 / 2


def step_scale(quality: float, span: float, weight_range: int) -> float:
    q = min(100.0, max(1.0, quality))
    levels = len(astc_hdr.weight_values(int(weight_range > 5), weight_range % 6 + 2))
    return (5000 / q if q < 50 else 200 - 2 * q) / 100 * 64 / max(span, LEAST_SPAN) * (63 / (levels - 1)) ** 0.1


def step(quality: float, scale: float, block: tuple[int, int], x: int, y: int) -> int:
    """The step of a coefficient, between the table's entries by its share of the block."""
    if quality >= 100:
        return 1
    at = [min(v * 8 / n, 7.0) for v, n in zip((x, y), block, strict=True)]
    (x0, tx), (y0, ty) = ((int(v), v - int(v)) for v in at)
    x1, y1 = min(x0 + 1, 7), min(y0 + 1, 7)
    rows = [(1 - tx) * STEPS[r][x0] + tx * STEPS[r][x1] for r in (y0, y1)]
    return max(1, int(((1 - ty) * rows[0] + ty * rows[1]) * scale + 0.5))


def coefficient(q: int, size: int, x: int, y: int) -> float:
    """The two lowest frequencies in whole steps, all others half a step further out."""
    return float(q * size) if (x, y) in ((1, 0), (0, 1)) else float(np.sign(q) * (abs(q) + 0.5) * size)


@functools.cache
def basis(n: int) -> np.ndarray:
    """(frequency, place) of the orthonormal cosine transform."""
    u, x = np.arange(n)[:, None], np.arange(n)[None]
    return np.where(u == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * (2 * x + 1) * u / (2 * n))


def inverse(freq: np.ndarray) -> np.ndarray:
    """(..., height, width) of coefficients of that shape."""
    return np.einsum("uy,...uv,vx->...yx", basis(freq.shape[-2]), freq, basis(freq.shape[-1]))


@dataclass(frozen=True)
class Plane:
    mean: int
    runs: tuple[int, ...]
    values: tuple[int, ...]


def read(d: Decoder, n: int, means: SymbolModel, runs: SymbolModel, sizes: SymbolModel) -> Plane:
    """One plane of n weights."""
    mean, at, zeros, values = d.symbol(means), 1, [], []
    while at < n:
        run = d.symbol(runs)
        if run == LAST:
            break
        at += run + 1
        if at > n:
            raise ValueError("a run of zeros exceeds the weight grid")
        sign = -1 if d.bits(1) else 1
        zeros.append(run)
        values.append(sign * (d.symbol(sizes) + 1))
    return Plane(mean, tuple(zeros), tuple(values))


def weights(p: Plane, grid: tuple[int, int], block: tuple[int, int], weight_range: int, quality: float, span: float) -> np.ndarray:
    """(height, width) weights of 0 to 64 of a plane."""
    freq = np.zeros(grid[::-1])
    scale, at = step_scale(quality, span, weight_range), 1
    order = diagonal(*grid)
    for run, q in zip(p.runs, p.values, strict=True):
        at += run
        if at >= len(order):
            raise ValueError("a run of zeros exceeds the weight grid")
        x, y = order[at]
        freq[y, x] = coefficient(q, step(quality, scale, block, x, y), x, y)
        at += 1
    v = p.mean / mean_scale(weight_range) + inverse(freq)
    return np.clip(np.trunc(v + np.where(v >= 0, 0.5, -0.5)), 0, 64).astype(np.int64)


def codes(values: Sequence[Sequence[int]] | np.ndarray, weight_range: int) -> np.ndarray:
    """The first code whose weight is nearest."""
    table = astc_hdr.weight_values(int(weight_range > 5), weight_range % 6 + 2)
    return np.abs(table - np.asarray(values)[..., None]).argmin(-1)


def span(ends: Sequence[np.ndarray], second: int | None = None, plane: int = 0) -> float:
    """The longest distance of a pair of colours (4, 2), one a group; with two planes, over the plane's own components."""
    use = np.ones(4, bool) if second is None else (np.arange(4) == second) == bool(plane)
    return max(float(np.sqrt(((e[:, 1] - e[:, 0])[use].astype(float) ** 2).sum())) for e in ends)
