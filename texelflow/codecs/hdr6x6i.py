"""The 6 x 6 HDR intermediate: a bit stream of blocks that becomes physical ASTC HDR 6 x 6 blocks.

A block repeats the one before, is of one colour, keeps all but the weights of a block near it, or is coded: with end
points of its own, a neighbour's, or a neighbour's and differences. End points and weights are then brought to the
ranges that the physical block has room for.

Patterns of two and three groups are numbered by tables. Those of three are the seeds whose pattern has all groups and is
new but for the groups' names, ascending, and are worked out here. Those of two are the same, but in an order that
follows no rule known here: it is a parameter, and without it blocks with two groups are a fault."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np

from . import astc, astc_hdr, uastc
from .bits import Bits

#: Fixed values of the format: two planes, kind of end points, groups, weight grid, ranges of end points and weights in the stream
#: and in the physical block, component on the second plane.
MODES = (
    (0, 11, 1, 6, 6, 20, 1, 20, 1, 0), (0, 11, 1, 6, 6, 15, 2, 15, 2, 0), (0, 11, 1, 6, 5, 16, 3, 16, 3, 0), (0, 11, 1, 5, 6, 16, 3, 16, 3, 0),
    (0, 11, 1, 6, 4, 15, 5, 15, 5, 0), (0, 11, 1, 4, 6, 15, 5, 15, 5, 0), (0, 11, 1, 6, 3, 15, 8, 15, 8, 0), (0, 11, 1, 3, 6, 15, 8, 15, 8, 0),
    (0, 11, 1, 5, 5, 14, 5, 14, 5, 0), (0, 11, 1, 4, 4, 19, 8, 19, 8, 0), (0, 11, 1, 3, 3, 20, 8, 20, 8, 0), (0, 7, 1, 6, 6, 16, 3, 16, 3, 0),
    (0, 7, 1, 6, 6, 20, 1, 20, 1, 0), (0, 7, 1, 6, 6, 20, 2, 20, 2, 0), (0, 7, 1, 5, 6, 20, 4, 20, 4, 0), (0, 7, 1, 6, 5, 20, 4, 20, 4, 0),
    (0, 7, 1, 3, 6, 20, 9, 20, 9, 0), (0, 7, 1, 6, 3, 20, 9, 20, 9, 0), (0, 11, 2, 6, 6, 11, 0, 11, 0, 0), (0, 11, 2, 6, 3, 13, 1, 13, 1, 0),
    (0, 11, 2, 3, 6, 13, 1, 13, 1, 0), (0, 11, 2, 3, 6, 11, 2, 11, 2, 0), (0, 11, 2, 6, 3, 11, 2, 11, 2, 0), (0, 11, 2, 4, 6, 11, 1, 11, 1, 0),
    (0, 11, 2, 6, 4, 11, 1, 11, 1, 0), (0, 7, 2, 5, 6, 15, 1, 15, 1, 0), (0, 7, 2, 6, 5, 15, 1, 15, 1, 0), (0, 7, 2, 4, 6, 15, 2, 15, 2, 0),
    (0, 7, 2, 6, 4, 15, 2, 15, 2, 0), (0, 7, 2, 6, 6, 11, 1, 11, 1, 0), (0, 7, 2, 6, 6, 19, 0, 19, 0, 0), (0, 7, 2, 5, 5, 14, 2, 14, 2, 0),
    (0, 7, 2, 3, 6, 13, 5, 13, 5, 0), (0, 7, 2, 6, 3, 13, 5, 13, 5, 0), (0, 7, 2, 3, 6, 15, 4, 15, 4, 0), (0, 7, 2, 6, 3, 15, 4, 15, 4, 0),
    (1, 11, 1, 3, 6, 14, 2, 14, 2, 0), (1, 11, 1, 3, 6, 14, 2, 14, 2, 1), (1, 11, 1, 3, 6, 14, 2, 14, 2, 2), (1, 11, 1, 6, 3, 14, 2, 14, 2, 0),
    (1, 11, 1, 6, 3, 14, 2, 14, 2, 1), (1, 11, 1, 6, 3, 14, 2, 14, 2, 2), (1, 11, 1, 3, 3, 14, 8, 14, 8, 0), (1, 11, 1, 3, 3, 14, 8, 14, 8, 1),
    (1, 11, 1, 3, 3, 14, 8, 14, 8, 2), (1, 11, 1, 4, 4, 13, 3, 13, 3, 0), (1, 11, 1, 4, 4, 13, 3, 13, 3, 1), (1, 11, 1, 4, 4, 13, 3, 13, 3, 2),
    (1, 11, 1, 5, 5, 20, 0, 20, 0, 0), (1, 11, 1, 5, 5, 20, 0, 20, 0, 1), (1, 11, 1, 5, 5, 20, 0, 20, 0, 2), (1, 11, 1, 2, 2, 14, 2, 20, 5, 0),
    (1, 11, 1, 2, 2, 14, 2, 20, 5, 1), (1, 11, 1, 2, 2, 14, 2, 20, 5, 2), (0, 11, 1, 2, 2, 17, 0, 20, 1, 0), (0, 7, 3, 6, 6, 11, 0, 11, 0, 0),
    (0, 7, 3, 5, 5, 14, 0, 14, 0, 0), (0, 7, 3, 4, 4, 14, 1, 14, 1, 0), (0, 7, 3, 4, 4, 12, 2, 12, 2, 0), (0, 7, 3, 4, 4, 11, 3, 11, 3, 0),
    (0, 7, 3, 3, 3, 14, 5, 14, 5, 0), (0, 7, 3, 6, 4, 14, 0, 14, 0, 0), (0, 7, 3, 4, 6, 14, 0, 14, 0, 0), (0, 7, 3, 6, 4, 11, 1, 11, 1, 0),
    (0, 7, 3, 4, 6, 11, 1, 11, 1, 0), (0, 7, 3, 6, 5, 13, 0, 13, 0, 0), (0, 7, 3, 5, 6, 13, 0, 13, 0, 0), (0, 7, 3, 6, 3, 13, 1, 13, 1, 0),
    (0, 7, 3, 3, 6, 13, 1, 13, 1, 0), (0, 7, 3, 6, 3, 11, 2, 11, 2, 0), (0, 7, 3, 3, 6, 11, 2, 11, 2, 0), (0, 7, 3, 6, 3, 10, 3, 10, 3, 0),
    (0, 7, 3, 3, 6, 10, 3, 10, 3, 0), (0, 7, 3, 5, 4, 12, 1, 12, 1, 0), (0, 7, 3, 4, 5, 12, 1, 12, 1, 0),
)
#: Signatures, of which the older one's encoder took wrong weights of 2 x 2 grids; the end; bits of a difference.
SIGNATURES, END, DELTA_BITS, ROWS_KEPT = (0xABCD, 0xABCE), 0xA742, 5, 5
BLOCK = (6, 6)
MOST_PIXELS = 32768
#: Values of a pair of end points by kind, and which of their bits survive a change of range: red, green, blue of a scaled colour,
#: and of two colours unless both are stored plainly.
VALUES = {7: 4, 11: 6}
SCALED_KEEP, DIRECT_KEEP = (0xC0, 0xE0, 0xE0, 0xE0), (0, 0xC0, 0xC0, 0xC0, 0xE0, 0xE0)


def near(index: int) -> tuple[int, int]:
    """(columns, rows) to the block whose all but weights are kept: four to the left, then rows of eight above."""
    if index < 4:
        return -1 - index, 0
    return 3 - (index - 4) % 8, -1 - (index - 4) // 8


@functools.cache
def seeds(groups: int) -> tuple[int, ...]:
    """Least seeds of the different patterns that use all groups, ascending."""
    found: dict[tuple[int, ...], int] = {}
    for seed in range(1024):
        pattern = astc_hdr.subsets(seed, groups, *BLOCK)
        if len(np.unique(pattern)) == groups:
            names: dict[int, int] = {}
            found.setdefault(tuple(names.setdefault(int(g), len(names)) for g in pattern), seed)
    return tuple(sorted(found.values()))


@dataclass(frozen=True)
class Block:
    """Codes as in the stream; `solid` is a colour of halves."""

    mode: int = -1
    range: int = 0  # of the end points
    ends: tuple[int, ...] = ()
    weights: tuple[int, ...] = ()
    seed: int = 0
    solid: tuple[int, int, int] | None = None


def _codes(bits: Bits, n: int, r: int) -> tuple[int, ...]:
    """n codes of range r: first all bundles of trits or quints, then the low bits of each."""
    low, trits, quints = uastc.RANGES[r]
    radix = 3 if trits else 5 if quints else 1
    high = []
    if radix > 1:
        step = len(uastc.TAILS[radix]) - 1
        for at in range(0, n, step):
            own = min(step, n - at)
            packed = bits.take(uastc.TAILS[radix][own])
            high += [packed // radix**j % radix for j in range(own)]
    return tuple((bits.take(low) if low else 0) | (high[k] << low if high else 0) for k in range(n))


@functools.cache
def _weights(r: int) -> np.ndarray:
    """0 to 64 by code, of a range numbered as those of end points."""
    return astc_hdr.weight_values(int(r > 5), r % 6 + 2)


def _nearest(table: np.ndarray, value: int, keep: int = 0) -> int:
    """The first code whose value is nearest, among those with the same bits under `keep`, if there is any."""
    off = np.abs(table - value)
    if keep:
        same = (table & keep) == (value & keep)
        if same.any():
            off = np.where(same, off, 1 << 20)
    return int(off.argmin())


def _moved_ends(kind: int, ends: Sequence[int], source: int, to: int) -> tuple[int, ...]:
    """A pair's codes in another range."""
    if source == to:
        return tuple(ends)
    values = [int(uastc.endpoint_table(source)[c]) for c in ends]
    if to == 20:
        return tuple(values)
    keep = SCALED_KEEP if kind == 7 else (0,) * 6 if values[4] & values[5] & 0x80 else DIRECT_KEEP
    return tuple(_nearest(uastc.endpoint_table(to), v, k) for v, k in zip(values, keep, strict=True))


def _spread_weights(weights: Sequence[int], r: int, old: bool) -> tuple[int, ...]:
    """A 2 x 2 grid spread over 4 x 4."""
    table, out = _weights(r), []
    step = (1024 + 2) // 3
    for y in range(4):
        for x in range(4):
            gx, gy = (step * x + 32) >> 6, (step * y + 32) >> 6
            fx, fy = gx & 15, gy & 15
            both = (fx * fy + 8) >> 4
            total = 8
            for dy, dx, share in ((0, 0, 16 - fx - fy + both), (0, 1, fx - both), (1, 0, fy - both), (1, 1, both)):
                if share:
                    at = int(x + dx + 2 * (y + dy) < 4) if old else (gx >> 4) + dx + ((gy >> 4) + dy) * 2
                    total += int(table[weights[at]]) * share
            out.append(_nearest(table, total >> 4))
    return tuple(out)


@functools.cache
def _grid_codes() -> dict[tuple[int, int, int, int, int], int]:
    """Block mode by (width, height, precision, range number, planes); the first one that means it."""
    out: dict[tuple[int, int, int, int, int], int] = {}
    for code in range(1 << 11):
        try:
            out.setdefault(astc_hdr.grid(code), code)
        except ValueError:
            continue
    return out


def physical(b: Block, old: bool = False) -> bytes:
    """The block as ASTC."""
    if b.solid is not None:
        return bytes.fromhex("FCFFFFFFFFFFFFFF") + np.array([*b.solid, 0x3C00], "<u2").tobytes()
    dual, kind, groups, w, h, _, weight_range, ends_to, weights_to, second = MODES[b.mode]
    n = VALUES[kind]
    ends = [c for g in range(groups) for c in _moved_ends(kind, b.ends[g * n : g * n + n], b.range, ends_to)]
    weights = b.weights
    if weight_range != weights_to:
        weights = tuple(_nearest(_weights(weights_to), int(_weights(weight_range)[c])) for c in weights)
    if not dual and (w, h) == (2, 2):
        weights, (w, h) = _spread_weights(weights, weights_to, old), (4, 4)
    size = astc_hdr.ise_size(len(weights), uastc.RANGES[weights_to])
    bits = np.zeros((1, 128), np.int64)
    at = astc._put(bits, 0, _grid_codes()[w, h, int(weights_to > 5), weights_to % 6 + 2, 1 + dual], 11)
    at = astc._put(bits, at, groups - 1, 2)
    if groups > 1:
        at = astc._put(bits, astc._put(bits, at, b.seed, 10), kind << 2, 6)
    else:
        at = astc._put(bits, at, kind, 4)
    room = 128 - at - 2 * dual - size
    if not 24 <= size <= 96 or ends_to != max((r for r in range(4, 21) if astc_hdr.ise_size(len(ends), uastc.RANGES[r]) <= room), default=-1):
        raise ValueError("the block has no room for its end points or weights")
    astc._endpoints(bits, at, np.array([ends]), ends_to)
    if dual:
        astc._put(bits, 128 - size - 2, second, 2)
    run = np.zeros((1, 160), np.int64)
    astc._endpoints(run, 0, np.array([weights]), weights_to)
    bits[:, 128 - size :] |= run[:, :size][:, ::-1]  # weights run down from the top
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").tobytes()


def _coded(bits: Bits, at: tuple[int, int], kept: dict[tuple[int, int], Block], two: Sequence[int] | None) -> Block:
    mode, how = bits.truncated(len(MODES)), bits.truncated(5)
    dual, kind, groups, w, h, ends_range, weight_range, _, _, _ = MODES[mode]
    n_weights = w * h * (1 + dual)
    if how == 0:
        seed = 0
        if groups > 1:
            table = seeds(3) if groups == 3 else two
            number = bits.truncated(len(seeds(groups)))
            if table is None:
                raise ValueError("blocks with two groups need the order of their patterns")
            seed = table[number]
        ends = _codes(bits, VALUES[kind] * groups, ends_range)
        return Block(mode, ends_range, ends, _codes(bits, n_weights, weight_range), seed)
    x, y = at
    beside = kept.get((x - 1, y) if how in (1, 3) else (x, y - 1))
    if beside is None or beside.solid is not None or MODES[beside.mode][1] != kind:
        raise ValueError("a neighbour's end points can't be taken")
    own = beside.ends[: VALUES[kind]]
    if how < 3:
        return Block(mode, beside.range, own, _codes(bits, n_weights, weight_range))
    table = uastc.endpoint_table(ends_range)
    order = np.argsort(table, kind="stable")
    moved = []
    for c in _moved_ends(kind, own, beside.range, ends_range):
        rank = int(np.flatnonzero(order == c)[0]) + bits.take(DELTA_BITS) - (1 << DELTA_BITS - 1)
        if not 0 <= rank < len(order):
            raise ValueError("end point difference out of range")
        moved.append(int(order[rank]))
    return Block(mode, ends_range, tuple(moved), _codes(bits, n_weights, weight_range))


def blocks(data: bytes, width: int, height: int, two: Sequence[int] | None = None) -> bytes:
    """ASTC HDR 6 x 6 blocks of a slice; a fault is a ValueError."""
    bits = Bits(data)
    signature, size = bits.take(16), (bits.take(16), bits.take(16))
    if signature not in SIGNATURES:
        raise ValueError("no 6x6 intermediate stream")
    if size != (width, height) or not 0 < min(size) <= max(size) <= MOST_PIXELS:
        raise ValueError("the stream has another size")
    nx, ny = -(-width // 6), -(-height // 6)
    kept: dict[tuple[int, int], Block] = {}
    out: list[bytes] = []
    while len(out) < nx * ny:
        if bits.at >= 8 * len(data):
            raise ValueError("the stream ends early")
        y, x = divmod(len(out), nx)
        if bits.take(1):
            b = _coded(bits, (x, y), kept, two)
        elif bits.take(1):
            dx, dy = near(bits.take(5))
            source = kept.get((x + dx, y + dy)) if not (x == y == 0) else None
            if source is None or source.solid is not None:
                raise ValueError("no such block near")
            _, _, _, w, h, _, weight_range, *_ = MODES[source.mode]
            b = replace(source, weights=_codes(bits, w * h * (1 + MODES[source.mode][0]), weight_range))
        elif bits.take(1):
            b = Block(solid=(bits.take(15), bits.take(15), bits.take(15)))
        else:
            n = bits.chunked(5) + 1
            if not out or n > nx * ny - len(out):
                raise ValueError("a run without a block before it, or past the end")
            py, px = divmod(len(out) - 1, nx)
            for k in range(len(out), len(out) + n):
                kept[k % nx, k // nx] = kept[px, py]
            out += [out[-1]] * n
            continue
        kept[x, y] = b
        out.append(physical(b, signature == SIGNATURES[0]))
        if x == nx - 1:  # only the rows above that can be named stay
            for k in range(nx):
                kept.pop((k, y - ROWS_KEPT + 1), None)
    if bits.take(16) != END:
        raise ValueError("no end of the stream")
    return b"".join(out)


def image(data: bytes, width: int, height: int, target: str, two: Sequence[int] | None = None) -> bytes:
    return astc.hdr_image(blocks(data, width, height, two), width, height, "ASTC_HDR_6x6", target)


def images(content: bytes, r: dict, target: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of a KTX2 container whose slices hold such streams."""
    from ..sources.ktx2 import level_ranges, slice_ranges

    slices = slice_ranges(content, r)
    if not slices:
        raise ValueError("no slices")
    for level, (start, n, _) in enumerate(level_ranges(content, r["levels"])):
        w, h = max(1, r["width"] >> level), max(1, r["height"] >> level)
        for k in range(r["images"]):
            at, size, _ = slices[level * r["images"] + k]
            if at + size > n:
                raise ValueError("slice past its level")
            yield k, level, w, h, image(content[start + at :][:size], w, h, target)
