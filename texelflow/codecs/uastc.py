"""UASTC LDR 4x4 blocks to texels, all blocks of a mode at once.

A block's mode fixes where its fields lie, but for the weights of partitioned modes, whose anchors depend on the
pattern; so blocks are grouped by mode and pattern and their bits read as columns of a matrix."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packers


@dataclass(frozen=True)
class Mode:
    code: int  # prefix, lowest bit first
    size: int  # its bits
    components: int = 0
    subsets: int = 0
    planes: int = 0
    endpoint_range: int = 0
    weight_bits: int = 0
    hints: int = 0
    pattern_bits: int = 0
    selector_bits: int = 0  # of the component on the second plane


#: The 19 modes. Mode 8 is the solid one.
MODES = (
    Mode(0x1, 4, 3, 1, 1, 19, 4, 15), Mode(0x35, 6, 3, 1, 1, 20, 2, 15), Mode(0x1D, 5, 3, 2, 1, 8, 3, 15, 5), Mode(0x3, 5, 3, 3, 1, 7, 2, 15, 4),
    Mode(0x13, 5, 3, 2, 1, 12, 2, 15, 5), Mode(0xB, 5, 3, 1, 1, 20, 3, 15), Mode(0x1B, 5, 3, 1, 2, 18, 2, 15, 0, 2), Mode(0x7, 5, 3, 2, 1, 12, 2, 15, 5),
    Mode(0x17, 5), Mode(0xF, 5, 4, 2, 1, 8, 2, 23, 5), Mode(0x2, 3, 4, 1, 1, 13, 4, 17), Mode(0x0, 2, 4, 1, 2, 13, 2, 17, 0, 2),
    Mode(0x6, 3, 4, 1, 1, 19, 3, 17), Mode(0x1F, 5, 4, 1, 2, 20, 1, 23, 0, 2), Mode(0xD, 5, 4, 1, 1, 20, 2, 23), Mode(0x5, 7, 2, 1, 1, 20, 4, 23),
    Mode(0x15, 6, 2, 2, 1, 20, 2, 23, 5), Mode(0x25, 6, 2, 1, 2, 20, 2, 23), Mode(0x9, 4, 3, 1, 1, 11, 5, 15),
)
SOLID = 8
#: Partition seeds by pattern, for two subsets, for three, and for mode 7.
SEEDS_2 = (28, 20, 16, 29, 91, 9, 107, 72, 149, 204, 50, 114, 496, 17, 78, 39, 252, 828, 43, 156, 116, 210, 476, 273, 684, 359, 246, 195, 694, 524)
SEEDS_3 = (260, 74, 32, 156, 183, 15, 745, 0, 335, 902, 254)
SEEDS_7 = (36, 48, 61, 137, 161, 183, 226, 281, 302, 307, 479, 495, 593, 594, 605, 799, 812, 988, 993)
#: Fixed values: (bits, trits, quints) of the endpoint ranges 0 to 20.
RANGES = ((1, 0, 0), (0, 1, 0), (2, 0, 0), (0, 0, 1), (1, 1, 0), (3, 0, 0), (1, 0, 1), (2, 1, 0), (4, 0, 0), (2, 0, 1), (3, 1, 0), (5, 0, 0), (3, 0, 1), (4, 1, 0), (6, 0, 0), (4, 0, 1), (5, 1, 0), (7, 0, 0), (5, 0, 1), (6, 1, 0), (8, 0, 0))
#: Fixed values of the ASTC specification: by (radix, bits) the bit pattern B, highest bit first, and the factor C.
SPREAD = {(3, 1): ("000000000", 204), (3, 2): ("b000b0bb0", 93), (3, 3): ("cb000cbcb", 44), (3, 4): ("dcb000dcb", 22), (3, 5): ("edcb000ed", 11), (3, 6): ("fedcb000f", 5), (5, 1): ("000000000", 113), (5, 2): ("b0000bb00", 54), (5, 3): ("cb0000cbc", 26), (5, 4): ("dcb0000dc", 13), (5, 5): ("edcb0000e", 6)}
#: Bits of a last bundle with so many values.
TAILS = {3: (0, 2, 4, 5, 7, 8), 5: (0, 3, 5, 7)}


@functools.cache
def mode_of() -> np.ndarray:
    """Mode by a block's lowest seven bits; 19 is reserved."""
    out = np.full(128, len(MODES))
    for k, m in enumerate(MODES):
        out[np.arange(128) & ((1 << m.size) - 1) == m.code] = k
    return out


def replicated(v: np.ndarray, bits: int, to: int) -> np.ndarray:
    out, at = np.zeros_like(v), to - bits
    while at > -bits:
        out |= v << at if at >= 0 else v >> -at
        at -= bits
    return out


@functools.cache
def endpoint_table(r: int) -> np.ndarray:
    """8-bit value of each code of an endpoint range: low bits, then trit or quint above."""
    bits, trits, quints = RANGES[r]
    radix = 3 if trits else 5 if quints else 1
    code = np.arange(radix << bits)
    if radix == 1:
        return replicated(code, bits, 8)
    pattern, factor = SPREAD[radix, bits]
    b = sum(((code >> (ord(c) - ord("a"))) & 1) << (8 - k) for k, c in enumerate(pattern) if c != "0")
    a = (code & 1) * 511
    return (a & 0x80) | ((((code >> bits) * factor + b) ^ a) >> 2)


@functools.cache
def weight_table(bits: int) -> np.ndarray:
    v = replicated(np.arange(1 << bits), bits, 6)
    return v + (v > 32)


@functools.cache
def partition(seed: int, subsets: int) -> np.ndarray:
    """Subset of each of 16 texels."""
    u32 = (1 << 32) - 1
    s = p = seed + 1024 * (subsets - 1)
    for kind, n in (("x", -15), ("-", 17), ("+", 7), ("+", 4), ("x", -5), ("+", 16), ("x", -7), ("x", -3), ("x", 6), ("x", -17)):
        moved = p >> -n if n < 0 else p << n
        p = {"x": p ^ moved, "+": p + moved, "-": p - moved}[kind] & u32
    shifts = [4 if s & 2 else 5, 6 if subsets == 3 else 5]
    if not s & 1:
        shifts.reverse()
    factor = [((p >> 4 * k & 15) ** 2) >> (shifts[k % 2]) for k in range(8)]
    x, y = np.arange(16) % 4 * 2, np.arange(16) // 4 * 2  # small blocks count double
    levels = [(factor[2 * k] * x + factor[2 * k + 1] * y + (p >> shift)) & 63 for k, shift in enumerate((14, 10, 6, 2)[:subsets])]
    return np.argmax(levels, axis=0)


def field(bits: np.ndarray, at: int, n: int) -> np.ndarray:
    return bits[:, at : at + n] @ (1 << np.arange(n)) if n else np.zeros(len(bits), np.int64)


def _endpoints(bits: np.ndarray, at: int, n: int, r: int) -> tuple[np.ndarray, int]:
    """(blocks, n) endpoint codes and where they end: bundles of trits or quints first, then the low bits."""
    low, trits, quints = RANGES[r]
    radix = 3 if trits else 5 if quints else 1
    out = np.zeros((len(bits), n), np.int64)
    if radix > 1:
        bundle = len(TAILS[radix]) - 1
        for k in range(0, n, bundle):
            own = min(bundle, n - k)
            size = TAILS[radix][own]
            packed = field(bits, at, size)
            at += size
            for j in range(own):
                out[:, k + j] = packed // radix**j % radix << low
    for k in range(n):
        out[:, k] += field(bits, at, low)
        at += low
    return out, at


@dataclass(frozen=True)
class Fields:
    """What blocks of one mode and pattern hold: codes (blocks, subsets, components, 2), weights (blocks, 16, planes)."""

    mode: Mode
    seed: int
    subset: np.ndarray
    second: np.ndarray  # component on the second plane
    codes: np.ndarray
    weights: np.ndarray


def fields(bits: np.ndarray, k: int) -> Fields:
    m = MODES[k]
    at, seed = m.size + m.hints, 0
    subset = np.zeros(16, np.int64)
    if m.pattern_bits:
        seeds = SEEDS_7 if k == 7 else SEEDS_3 if m.subsets == 3 else SEEDS_2
        pattern = int(field(bits[:1], at, m.pattern_bits)[0])
        if pattern >= len(seeds):
            raise ValueError("invalid UASTC pattern")
        seed = seeds[pattern]
        subset = partition(seed, m.subsets)
        at += m.pattern_bits
    second = np.full(len(bits), 3) if m.planes == 2 and not m.selector_bits else field(bits, at, m.selector_bits)
    at += m.selector_bits
    codes, at = _endpoints(bits, at, m.components * 2 * m.subsets, m.endpoint_range)
    anchors = {int(np.argmax(subset == s)) for s in range(m.subsets)}
    weights = np.zeros((len(bits), 16, m.planes), np.int64)
    for t in range(16):
        for p in range(m.planes):
            size = m.weight_bits - (t in anchors)
            weights[:, t, p] = field(bits, at, size)
            at += size
    return Fields(m, seed, subset, second, codes.reshape(len(bits), m.subsets, m.components, 2), weights)


def _decoded(bits: np.ndarray, k: int) -> np.ndarray:
    """(blocks, 16, 4) texels of blocks of one mode and, if it has patterns, one pattern."""
    f = fields(bits, k)
    m = f.mode
    ends = endpoint_table(m.endpoint_range)[f.codes]
    # blue contraction never applies: its swap of end points and of weights cancels out
    full = np.full((len(bits), m.subsets, 4, 2), 255)
    if m.components == 2:
        full[:, :, :3], full[:, :, 3] = ends[:, :, :1], ends[:, :, 1]
    else:
        full[:, :, : m.components] = ends
    weights = weight_table(m.weight_bits)[f.weights]
    own = np.repeat(weights[:, :, :1], 4, axis=2)
    if m.planes == 2:
        own = np.where(np.arange(4)[None, None] == f.second[:, None, None], weights[:, :, 1:], own)
    lo, hi = full[..., 0][:, f.subset] * 257, full[..., 1][:, f.subset] * 257
    return ((lo * (64 - own) + hi * own + 32) >> 14).astype(np.uint8)


def grouped(blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(mode, places, bits) of blocks (n, 16) that share mode and pattern."""
    bits = np.unpackbits(blocks, axis=1, bitorder="little").astype(np.int64)
    modes = mode_of()[blocks[:, 0] & 127]
    for k in np.unique(modes):
        if k == len(MODES):
            raise ValueError("reserved UASTC mode")
        m, here = MODES[k], np.flatnonzero(modes == k)
        pattern = field(bits[here], m.size + m.hints, m.pattern_bits)
        for p in np.unique(pattern):
            own = here[pattern == p]
            yield int(k), own, bits[own]


def texels(blocks: np.ndarray) -> np.ndarray:
    """(n, 16, 4) RGBA of blocks (n, 16), texels row by row."""
    out = np.zeros((len(blocks), 16, 4), np.uint8)
    for k, here, bits in grouped(blocks):
        if k == SOLID:
            out[here] = np.stack([field(bits, MODES[k].size + 8 * c, 8) for c in range(4)], axis=1)[:, None]
        else:
            out[here] = _decoded(bits, k)
    return out


def image(data: bytes, width: int, height: int, target: str = "RGBA8") -> bytes:
    nx, ny = -(-width // 4), -(-height // 4)
    if len(data) != nx * ny * 16:
        raise ValueError("UASTC block data size mismatch")
    source = np.frombuffer(data, np.uint8).reshape(-1, 16)
    if target == "ASTC_LDR_4X4":
        from . import astc

        return astc.pack(source).tobytes()
    from . import uastc_hints

    if target in uastc_hints.HINTED:
        return b"".join(uastc_hints.pack(source[k : k + packers.CHUNK], target).tobytes() for k in range(0, len(source), packers.CHUNK))
    whole = texels(source).reshape(ny, nx, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(ny * 4, nx * 4, 4)
    return packers.finish(whole, width, height, target)


def images(content: bytes, r: dict, target: str = "RGBA8") -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of a KTX2 container with this colour model."""
    from ..sources.ktx2 import block_images

    for k, level, w, h, data in block_images(content, r, (4, 4)):
        yield k, level, w, h, image(data, w, h, target)


def decoded(rows: DataFrame) -> DataFrame:
    """path, image, level, width, height, rgba, error of descriptors() rows of this format (KTX2)."""
    wanted = rows.filter("error is null and texture_format = 'UASTC_LDR_4x4'").select("path", "content", "scheme", "images", "levels", "width", "height", "texture_format")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    out = [(r["path"], *x, None) for x in images(r["content"], r)]
                except ValueError as e:
                    out = [(r["path"], None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["path", "image", "level", "width", "height", "rgba", "error"])

    return wanted.mapInArrow(run, "path string, image int, level int, width int, height int, rgba binary, error string")
