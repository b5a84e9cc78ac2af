"""ASTC blocks of any two-dimensional size to half floats, as the format's HDR profile defines them.

Blocks whose header is the same (mode, partitions, seed, kinds of end points) are decoded together."""

from __future__ import annotations

import functools

import numpy as np

from . import astc, uastc

#: Fixed values of the format: (bits, trits, quints) of weights by range number 2 to 7, of low and of high precision.
WEIGHTS = (((1, 0, 0), (0, 1, 0), (2, 0, 0), (0, 0, 1), (1, 1, 0), (3, 0, 0)), ((1, 0, 1), (2, 1, 0), (4, 0, 0), (2, 0, 1), (3, 1, 0), (5, 0, 0)))
#: Weights with trits or quints: by (radix, bits) the pattern B, highest bit first, and the factor C.
WEIGHT_SPREAD = {(3, 1): ("0000000", 50), (3, 2): ("b000b0b", 23), (3, 3): ("cb000cb", 11), (5, 1): ("0000000", 28), (5, 2): ("b0000b0", 13)}
WEIGHT_DIGITS = {3: (0, 32, 63), 5: (0, 16, 32, 47, 63)}
#: Fixed values of the ASTC specification (HDR end point modes 7 and 11): where the spare bits of a colour go, as (modes
#: that use it, spare bit, field, place), and shifts and widths by mode.
RGB_SCALE_BITS = (
    (0x30, 0, "g", 6), (0x3A, 1, "g", 5), (0x30, 2, "b", 6), (0x3A, 3, "b", 5), (0x3D, 6, "s", 5), (0x2D, 5, "s", 6), (0x04, 4, "s", 7),
    (0x3B, 4, "r", 6), (0x04, 3, "r", 6), (0x10, 5, "r", 7), (0x0F, 2, "r", 7), (0x05, 1, "r", 8), (0x0A, 0, "r", 8), (0x05, 0, "r", 9),
    (0x02, 6, "r", 9), (0x01, 3, "r", 10), (0x02, 5, "r", 10),
)
RGB_BITS = (
    (0xA4, 0, "a", 9), (0x08, 2, "a", 9), (0x50, 4, "a", 9), (0x50, 5, "a", 10), (0xA0, 1, "a", 10), (0xC0, 2, "a", 11), (0x04, 1, "c", 6),
    (0xE8, 3, "c", 6), (0x20, 2, "c", 7), (0x5B, 0, "b0", 6), (0x5B, 1, "b1", 6), (0x12, 2, "b0", 7), (0x12, 3, "b1", 7),
)
RGB_SCALE_SHIFT = (1, 1, 2, 3, 4, 5)
RGB_DELTA_BITS = (7, 6, 7, 6, 5, 6, 5, 6)
HDR_ONE = 0x780
FAULT = 0xFFFF
HDR_KINDS = (2, 3, 7, 11, 14, 15)


@functools.cache
def weight_values(high: int, number: int) -> np.ndarray:
    """0 to 64 by the code of a weight."""
    bits, trits, quints = WEIGHTS[high][number - 2]
    radix = 3 if trits else 5 if quints else 1
    if radix == 1:
        return uastc.weight_table(bits)
    if bits == 0:
        v = np.array(WEIGHT_DIGITS[radix])
    else:
        code = np.arange(radix << bits)
        pattern, factor = WEIGHT_SPREAD[radix, bits]
        b = sum(((code >> (ord(c) - ord("a"))) & 1) << (6 - k) for k, c in enumerate(pattern) if c != "0")
        a = (code & 1) * 127
        v = (a & 0x20) | (((code >> bits) * factor + b ^ a) >> 2)
    return v + (v > 32)


@functools.cache
def digits(radix: int) -> np.ndarray:
    decode = astc._trits if radix == 3 else astc._quints
    return np.array([decode(code) for code in range(1 << sum(astc.PARTS[radix]))])


def ise_size(n: int, kind: tuple[int, int, int]) -> int:
    bits, trits, quints = kind
    return n * bits + -(-8 * n * trits // 5) + -(-7 * n * quints // 3)


def _sequence(bits: np.ndarray, at: int, n: int, kind: tuple[int, int, int]) -> np.ndarray:
    """(blocks, n) codes of an integer sequence; bits past its end count as 0."""
    low, trits, quints = kind
    radix = 3 if trits else 5 if quints else 1
    out = np.zeros((len(bits), n), np.int64)
    cuts = astc.PARTS.get(radix, (0,))
    for k in range(0, n, len(cuts)):
        packed, shift, own = np.zeros(len(bits), np.int64), 0, min(len(cuts), n - k)
        for j in range(own):
            out[:, k + j] = uastc.field(bits, at, low)
            packed |= uastc.field(bits, at + low, cuts[j]) << shift
            at, shift = at + low + cuts[j], shift + cuts[j]
        if radix > 1:
            out[:, k : k + own] |= digits(radix)[packed][:, :own] << low
    return out


@functools.cache
def grid(mode: int) -> tuple[int, int, int, int, int]:
    """(width, height, precision, range number, planes) of a block mode; ValueError if reserved."""
    a, b, high, planes = mode >> 5 & 3, mode >> 7 & 3, mode >> 9 & 1, 1 + (mode >> 10 & 1)
    if mode & 3:
        number, kind = (mode & 3) << 1 | mode >> 4 & 1, mode >> 2 & 3
        if kind < 2:
            size = (b + 4 + 4 * kind, a + 2)
        elif kind == 2:
            size = (a + 2, b + 8)
        else:
            size = ((b & 1) + 2, a + 2) if mode & 0x100 else (a + 2, (b & 1) + 6)
    else:
        number = (mode >> 2 & 3) << 1 | mode >> 4 & 1
        if b == 2:
            size, high, planes = (a + 6, (mode >> 9 & 3) + 6), 0, 1
        elif b == 3 and a > 1:
            raise ValueError("reserved block mode")
        else:
            size = (12, a + 2) if b == 0 else (a + 2, 12) if b == 1 else ((6, 10), (10, 6))[a]
    if number < 2:
        raise ValueError("reserved block mode")
    return *size, high, number, planes


@functools.cache
def subsets(seed: int, parts: int, width: int, height: int) -> np.ndarray:
    """Subset of each texel, row by row."""
    if parts == 1:
        return np.zeros(width * height, np.int64)
    u32, s = (1 << 32) - 1, seed + 1024 * (parts - 1)
    p = s
    for kind, n in (("x", -15), ("-", 17), ("+", 7), ("+", 4), ("x", -5), ("+", 16), ("x", -7), ("x", -3), ("x", 6), ("x", -17)):
        moved = p >> -n if n < 0 else p << n
        p = {"x": p ^ moved, "+": p + moved, "-": p - moved}[kind] & u32
    shifts = [4 if s & 2 else 5, 6 if parts == 3 else 5]
    if not s & 1:
        shifts.reverse()
    factor = [((p >> 4 * k & 15) ** 2) >> shifts[k % 2] for k in range(8)]
    scale = 2 if width * height < 31 else 1
    x, y = np.arange(width * height) % width * scale, np.arange(width * height) // width * scale
    levels = [(factor[2 * k] * x + factor[2 * k + 1] * y + (p >> shift)) & 63 for k, shift in enumerate((14, 10, 6, 2)[:parts])]
    return np.argmax(levels, axis=0)


def _spread(weights: np.ndarray, size: tuple[int, int], block: tuple[int, int]) -> np.ndarray:
    """(blocks, texels, planes) of a weight grid (blocks, w * h, planes)."""
    if size == block:
        return weights
    places = []
    for n, most in zip(block, size, strict=True):
        step = (1024 + n // 2) // (n - 1)
        g = (step * np.arange(n) * (most - 1) + 32) >> 6
        places.append((g >> 4, g & 15))
    (ix, fx), (iy, fy) = places
    ix, fx, iy, fy = np.tile(ix, block[1]), np.tile(fx, block[1]), np.repeat(iy, block[0]), np.repeat(fy, block[0])
    both = (fx * fy + 8) >> 4
    at = iy * size[0] + ix
    last = size[0] * size[1] - 1
    take = lambda off, w: weights[:, np.minimum(at + off, last)] * w[None, :, None]
    return (take(0, 16 - fx - fy + both) + take(1, fx - both) + take(size[0], fy - both) + take(size[0] + 1, both) + 8) >> 4


def _placed(fields: dict[str, np.ndarray], spare: list[np.ndarray], mode: np.ndarray, table: tuple) -> None:
    for modes, bit, name, place in table:
        fields[name] = fields[name] | np.where(modes >> mode & 1, spare[bit] << place, 0)


def _majored(rgb: np.ndarray, major: np.ndarray) -> np.ndarray:
    """Red changes places with the major component."""
    order = np.array(((0, 1, 2), (1, 0, 2), (2, 1, 0), (0, 1, 2)))[major]
    return np.take_along_axis(rgb, order, 1)


def _rgb_scale(v: np.ndarray) -> np.ndarray:
    v0, v1, v2, v3 = v.T
    m = v0 >> 6 & 3 | (v1 >> 7) << 2 | (v2 >> 7) << 3
    major = np.where(m & 12 != 12, m >> 2, np.where(m != 15, m & 3, 0))
    mode = np.where(m & 12 != 12, m & 3, np.where(m != 15, 4, 5))
    f = {"r": v0 & 63, "g": v1 & 31, "b": v2 & 31, "s": v3 & 31}
    _placed(f, [v1 >> 6 & 1, v1 >> 5 & 1, v2 >> 6 & 1, v2 >> 5 & 1, v3 >> 7 & 1, v3 >> 6 & 1, v3 >> 5 & 1], mode, RGB_SCALE_BITS)
    shift = np.array(RGB_SCALE_SHIFT)[mode]
    r, g, b, s = (f[k] << shift for k in "rgbs")
    g, b = np.where(mode != 5, r - g, g), np.where(mode != 5, r - b, b)
    high = _majored(np.stack([r, g, b], 1), major)
    return np.clip(np.stack([high - s[:, None], high], 2), 0, 0xFFF)


def _rgb_direct(v: np.ndarray) -> np.ndarray:
    v0, v1, v2, v3, v4, v5 = v.T
    major = v4 >> 7 | (v5 >> 7) << 1
    mode = v1 >> 7 | (v2 >> 7) << 1 | (v3 >> 7) << 2
    f = {"a": v0 | (v1 & 64) << 2, "b0": v2 & 63, "b1": v3 & 63, "c": v1 & 63}
    _placed(f, [v2 >> 6 & 1, v3 >> 6 & 1, v4 >> 6 & 1, v5 >> 6 & 1, v4 >> 5 & 1, v5 >> 5 & 1], mode, RGB_BITS)
    sign = 1 << np.array(RGB_DELTA_BITS)[mode] - 1
    shift = (mode >> 1) ^ 3
    d0, d1 = (((((d & (2 * sign - 1)) ^ sign) - sign) << shift) for d in (v4 & 127, v5 & 127))
    a, b0, b1, c = (f[k] << shift for k in ("a", "b0", "b1", "c"))
    low = _majored(np.stack([a - c, a - b0 - c - d0, a - b1 - c - d1], 1), major)
    high = _majored(np.stack([a, a - b0, a - b1], 1), major)
    plain = np.stack([np.stack([v0 << 4, v2 << 4, (v4 & 127) << 5], 1), np.stack([v1 << 4, v3 << 4, (v5 & 127) << 5], 1)], 2)
    return np.where((major == 3)[:, None, None], plain, np.clip(np.stack([low, high], 2), 0, 0xFFF))


def _alpha_hdr(v6: np.ndarray, v7: np.ndarray) -> np.ndarray:
    mode = v6 >> 7 | (v7 >> 7) << 1
    a, b = v6 & 127, v7 & 127
    wide = a | (b << mode + 1) & 0x780
    sign = 0x20 >> mode
    delta = ((b & (0x3F >> mode)) ^ sign) - sign
    shift = np.maximum(4 - mode, 0)
    first = wide << shift
    second = np.clip(first + (delta << shift), 0, 0xFFF)
    plain = mode == 3
    return np.stack([np.where(plain, a << 5, first), np.where(plain, b << 5, second)], 1)


def _luminance_hdr(v: np.ndarray, kind: int) -> np.ndarray:
    v0, v1 = v.T
    if kind == 2:
        rising = v1 >= v0
        return np.stack([np.where(rising, v0 << 4, (v1 << 4) + 8), np.where(rising, v1 << 4, (v0 << 4) - 8)], 1)
    fine = v0 & 128 == 0
    first = np.where(fine, (v1 & 0xF0) << 4 | (v0 & 127) << 1, (v1 & 0xE0) << 4 | (v0 & 127) << 2)
    return np.stack([first, np.minimum(first + np.where(fine, (v1 & 15) << 1, (v1 & 31) << 2), 0xFFF)], 1)


def _ldr(v: np.ndarray, kind: int) -> np.ndarray:
    """(blocks, 4, 2) of 8 bits."""
    pair = lambda k: v[:, 2 * k : 2 * k + 2]
    out = np.full((len(v), 4, 2), 255)
    if kind in (0, 4):
        out[:, :3] = pair(0)[:, None]
        if kind == 4:
            out[:, 3] = pair(1)
        return out
    if kind == 1:
        first = v[:, 0] >> 2 | v[:, 1] & 0xC0
        out[:, :3] = np.stack([first, np.minimum(first + (v[:, 1] & 63), 255)], 1)[:, None]
        return out
    if kind in (6, 10):
        out[:, :3, 1] = v[:, :3]
        out[:, :3, 0] = v[:, :3] * v[:, 3:4] >> 8
        if kind == 10:
            out[:, 3] = v[:, 4:6]
        return out
    ends = v.reshape(len(v), -1, 2).copy()
    if kind in (5, 9, 13):  # base and signed offset
        base, off = ends[..., 0], ends[..., 1]
        off, base = off >> 1 & 63, base >> 1 | off & 128
        off = (off ^ 32) - 32
        swap = off[:, :3].sum(1) < 0
        ends = np.stack([base, base + off], 2)
        if kind == 5:
            ends = np.clip(ends, 0, 255)
            out[:, :3], out[:, 3] = ends[:, :1], ends[:, 1]
            return out
    else:
        swap = ends[:, :3, 1].sum(1) < ends[:, :3, 0].sum(1)
    ends = np.where(swap[:, None, None], ends[..., ::-1], ends)
    contracted = ends.copy()
    contracted[:, :2] = (ends[:, :2] + ends[:, 2:3]) >> 1
    out[:, : ends.shape[1]] = np.clip(np.where(swap[:, None, None], contracted, ends), 0, 255)
    return out


def ends_of(v: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, 4, 2) end points of 16 bits of one kind, and which components are HDR."""
    if kind not in HDR_KINDS:
        return _ldr(v, kind) * 257, np.zeros(4, bool)
    out = np.full((len(v), 4, 2), HDR_ONE << 4)
    hdr = np.ones(4, bool)
    if kind in (2, 3):
        out[:, :3] = _luminance_hdr(v, kind)[:, None] << 4
    else:
        out[:, :3] = (_rgb_scale(v) if kind == 7 else _rgb_direct(v[:, :6])) << 4
    if kind == 14:
        out[:, 3], hdr[3] = v[:, 6:8] * 257, False
    elif kind == 15:
        out[:, 3] = _alpha_hdr(v[:, 6], v[:, 7]) << 4
    return out, hdr


def _hdr_half(c: np.ndarray) -> np.ndarray:
    m = c & 0x7FF
    m = np.where(m < 512, 3 * m, np.where(m < 1536, 4 * m - 512, 5 * m - 2048))
    return np.minimum((c >> 11 << 10) + (m >> 3), 0x7BFF)


def _unit_half(c: np.ndarray) -> np.ndarray:
    """Halves of c / 65536, cut, not rounded; 65535 is 1."""
    exact = c / 65536
    near = exact.astype(np.float16)
    code = near.view(np.uint16).astype(np.int64)
    return np.where(c == 65535, 0x3C00, code - (near.astype(np.float64) > exact))


def nine_e5(rgb: np.ndarray, nearest: bool) -> np.ndarray:
    """Words of three mantissas of 9 bits, red lowest, and an exponent; mantissas are rounded or cut."""
    v = np.clip(rgb, 0, 0xFF80)
    top = v.max(-1)
    exponent = np.maximum(np.frexp(top)[1] - 1, -16) + 16
    exponent = np.where(top > 0, exponent, 0)
    add = 0.5 if nearest else 0.0
    exponent = exponent + (np.floor(top / 2.0 ** (exponent - 24) + add) >= 512)
    m = np.floor(v / 2.0 ** (exponent - 24)[..., None] + add).astype(np.int64)
    return m[..., 0] | m[..., 1] << 9 | m[..., 2] << 18 | exponent.astype(np.int64) << 27


def _value(half: np.ndarray) -> np.ndarray:
    """Halves as numbers; not-a-number counts as 0, infinity as the greatest."""
    h = np.where(half & 0x7FFF > 0x7C00, 0, np.where(half == 0x7C00, 0x7BFF, half))
    return h.astype(np.uint16).view(np.float16).astype(np.float64)


def _halves(c: np.ndarray, hdr: np.ndarray) -> np.ndarray:
    return np.where(hdr, _hdr_half(c), _unit_half(c))


def _words(c: np.ndarray, hdr: np.ndarray) -> np.ndarray:
    return nine_e5(np.where(hdr, _value(_hdr_half(c)), np.where(c == 65535, 1.0, c / 65536))[..., :3], False)


def _group(bits: np.ndarray, block: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, texels, 4) interpolated components of blocks with one header, and which of them are HDR."""
    take = lambda at, n: int(uastc.field(bits[:1], at, n)[0])
    w, h, high, number, planes = grid(take(0, 11))
    parts, n_weights = 1 + take(11, 2), w * h * planes
    kind = WEIGHTS[high][number - 2]
    size = ise_size(n_weights, kind)
    if w > block[0] or h > block[1] or n_weights > 64 or not 24 <= size <= 96 or planes == 2 and parts == 4:
        raise ValueError("invalid weights")
    start, below, seed = (17, 128 - size, 0) if parts == 1 else (29, 128 - size, take(13, 10))
    if parts == 1:
        kinds = [take(13, 4)]
    elif take(23, 2) == 0:
        kinds = [take(25, 4)] * parts
    else:
        extra = 3 * parts - 4
        below -= extra
        each = take(25, 4) | take(below, extra) << 4
        kinds = [(take(23, 2) - 1 + (each >> k & 1)) << 2 | each >> (parts + 2 * k) & 3 for k in range(parts)]
    second = None
    if planes == 2:
        below -= 2
        second = uastc.field(bits, below, 2)
    counts = [((k >> 2) + 1) * 2 for k in kinds]
    fitting = [r for r in range(4, 21) if ise_size(sum(counts), uastc.RANGES[r]) <= below - start]
    if sum(counts) > 18 or not fitting:
        raise ValueError("no room for end points")
    values = uastc.endpoint_table(fitting[-1])[_sequence(bits, start, sum(counts), uastc.RANGES[fitting[-1]])]
    ends, hdr, at = [], [], 0
    for k, n in zip(kinds, counts, strict=True):
        e, f = ends_of(values[:, at : at + n], k)
        ends.append(e)
        hdr.append(f)
        at += n
    subset = subsets(seed, parts, *block)
    ends, hdr = np.stack(ends, 1)[:, subset], np.stack(hdr)[subset]
    weights = weight_values(high, number)[_sequence(bits[:, ::-1], 0, n_weights, kind)].reshape(len(bits), w * h, planes)
    weights = _spread(weights, (w, h), block)
    own = np.repeat(weights[:, :, :1], 4, axis=2)
    if planes == 2:
        own = np.where(np.arange(4)[None, None] == second[:, None, None], weights[:, :, 1:], own)
    c = (ends[..., 0] * (64 - own) + ends[..., 1] * own + 32) >> 6
    return c, np.broadcast_to(hdr[None], c.shape)


def _void(bits: np.ndarray, words: bool) -> np.ndarray:
    """(blocks, 1, 4) halves, or (blocks, 1) 9E5 words, of blocks of one colour, which is of halves or of 65536ths."""
    colour = np.stack([uastc.field(bits, 64 + 16 * k, 16) for k in range(4)], 1)
    hdr = uastc.field(bits, 9, 1)[:, None] == 1
    if words:
        return nine_e5(np.where(hdr, _value(colour), np.where(colour == 65535, 1.0, colour / 65536))[:, :3], True)[:, None]
    return np.where(hdr, colour, _unit_half(colour))[:, None]


def halves(blocks: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """(n, texels, 4) half floats as numbers of blocks (n, 16); all of an invalid block are FAULT."""
    return _texels(blocks, block, False)


def shared_exponents(blocks: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """(n, texels) 9E5 words; an invalid block is magenta."""
    return _texels(blocks, block, True)


def _texels(blocks: np.ndarray, block: tuple[int, int], words: bool) -> np.ndarray:
    bits = np.unpackbits(blocks, axis=1, bitorder="little").astype(np.int64)
    shape = (len(blocks), block[0] * block[1])
    out = np.full(shape, int(nine_e5(np.array([1.0, 0.0, 1.0]), True))) if words else np.full((*shape, 4), FAULT)
    void = uastc.field(bits, 0, 9) == 0x1FC
    out[void] = _void(bits[void], words)
    rest = np.flatnonzero(~void)
    parts = uastc.field(bits[rest], 11, 2)
    header = uastc.field(bits[rest], 0, 29)
    header = np.where(parts == 0, header & 0x1FFFF, header)
    for own in np.unique(header):
        here = rest[header == own]
        try:
            w, h, high, number, planes = grid(int(own) & 0x7FF)
            at = 128 - ise_size(w * h * planes, WEIGHTS[high][number - 2])
            n = 3 * (int(own) >> 11 & 3) - 1 if own >> 11 & 3 and own >> 23 & 3 else 0
            kinds = uastc.field(bits[here], at - n, n) if at >= 40 else np.zeros(len(here), np.int64)
            for k in np.unique(kinds):
                same = here[kinds == k]
                out[same] = (_words if words else _halves)(*_group(bits[same], block))
        except ValueError:
            continue  # the block's texels stay a fault's
    return out


def unorm8(blocks: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """(n, texels, 4) bytes of LDR blocks: the upper eight of sixteen bits."""
    half = _texels(blocks, block, False)
    exact = half.astype(np.uint16).view(np.float16).astype(np.float64)
    # halves of 16-bit values were cut to 11 bits; the upper eight are still there
    return np.where(exact >= 1, 255, np.floor(exact * 256)).astype(int)


#: Blocks decoded at a time.
CHUNK = 4096
TARGETS = ("RGB_HALF", "RGBA_HALF", "RGB_9E5")


def image(data: bytes, width: int, height: int, block: tuple[int, int], target: str) -> bytes:
    """An image's texels, row by row, little-endian."""
    source = np.frombuffer(data, np.uint8).reshape(-1, 16)
    nx, ny = -(-width // block[0]), -(-height // block[1])
    words = target == "RGB_9E5"
    got = [_texels(source[k : k + CHUNK], block, words).astype("<u4" if words else "<u2") for k in range(0, len(source), CHUNK)]
    t = np.concatenate(got).reshape(ny, nx, block[1], block[0], -1).transpose(0, 2, 1, 3, 4)
    t = t.reshape(ny * block[1], nx * block[0], -1)[:height, :width]
    return np.ascontiguousarray(t[..., :3] if target == "RGB_HALF" else t).tobytes()
