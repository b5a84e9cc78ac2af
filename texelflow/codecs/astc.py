"""ASTC blocks: LDR 4x4 ones of UASTC, and HDR ones as stored. UASTC and ASTC hold the same fields; LDR ones are
laid out anew, with no loss, for all blocks of a mode and pattern at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

from . import uastc

#: Fixed values: (weight range bits R2 R1 R0, high-precision bit) by bits of a weight.
WEIGHT_RANGE = {1: (2, 0), 2: (4, 0), 3: (7, 0), 4: (4, 1), 5: (7, 1)}
#: Colour endpoint mode by components: luminance and alpha, RGB, RGBA, all direct.
ENDPOINT_MODE = {2: 4, 3: 8, 4: 12}
#: How the bits of a bundle's trits or quints lie between the low bits of its values.
PARTS = {3: (2, 2, 1, 2, 1), 5: (3, 2, 2)}
VOID_EXTENT = 0xFFFFFFFFFFFFFDFC


def _trits(t: int) -> tuple[int, ...]:
    bit = lambda v, k: v >> k & 1
    if t >> 2 & 7 == 7:
        c, high = (t >> 5 & 7) << 2 | t & 3, (2, 2)
    else:
        c = t & 31
        high = (bit(t, 7), 2) if t >> 5 & 3 == 3 else (t >> 5 & 3, bit(t, 7))
    if c & 3 == 3:
        low = (bit(c, 3) << 1 | bit(c, 2) & ~bit(c, 3), bit(c, 4), 2)
    elif c >> 2 & 3 == 3:
        low = (c & 3, 2, 2)
    else:
        low = (bit(c, 1) << 1 | bit(c, 0) & ~bit(c, 1), c >> 2 & 3, bit(c, 4))
    return *low, *high


def _quints(q: int) -> tuple[int, ...]:
    bit = lambda k: q >> k & 1
    if q >> 1 & 3 == 3 and q >> 5 & 3 == 0:
        return 4, 4, bit(0) << 2 | (bit(4) & ~bit(0)) << 1 | bit(3) & ~bit(0)
    if q >> 1 & 3 == 3:
        c, third = (q >> 3 & 3) << 3 | (~q >> 5 & 3) << 1 | bit(0), 4
    else:
        c, third = q & 31, q >> 5 & 3
    return (c >> 3 & 3, 4, third) if c & 7 == 5 else (c & 7, c >> 3 & 3, third)


@functools.cache
def bundle_codes(radix: int) -> np.ndarray:
    """Code of a bundle by its digits, read as a number of this radix, first digit lowest. Of several codes the
    greatest counts, as in the usual tables."""
    n, decode = (5, _trits) if radix == 3 else (3, _quints)
    out = np.zeros(radix**n, np.int64)
    for code in range(1 << sum(PARTS[radix])):
        out[sum(d * radix**k for k, d in enumerate(decode(code)))] = code
    return out


def _put(bits: np.ndarray, at: int, value, n: int) -> int:
    bits[:, at : at + n] = (np.broadcast_to(np.asarray(value, np.int64), len(bits))[:, None] >> np.arange(n)) & 1
    return at + n


def _endpoints(bits: np.ndarray, at: int, codes: np.ndarray, r: int) -> None:
    low, trits, quints = uastc.RANGES[r]
    radix = 3 if trits else 5 if quints else 1
    group = len(PARTS[radix]) if radix > 1 else 1
    for k in range(0, codes.shape[1], group):
        own = codes[:, k : k + group]
        digits = (own >> low) @ radix ** np.arange(own.shape[1]) if radix > 1 else None
        packed = bundle_codes(radix)[digits] if radix > 1 else 0
        for j in range(own.shape[1]):  # a short bundle ends after its last value
            at = _put(bits, at, own[:, j], low)
            if radix > 1:
                size = PARTS[radix][j]
                at = _put(bits, at, packed & ((1 << size) - 1), size)
                packed >>= size


def _laid_out(source: np.ndarray, k: int) -> np.ndarray:
    """(n, 128) bits of blocks of one mode and pattern."""
    f = uastc.fields(source, k)
    m = f.mode
    codes, weights = f.codes.copy(), f.weights.copy()
    if m.components > 2:  # a lighter first end point would mean blue contraction
        lit = uastc.endpoint_table(m.endpoint_range)[codes][:, :, :3].sum(2)
        swap = lit[..., 1] < lit[..., 0]
        codes = np.where(swap[..., None, None], codes[..., ::-1], codes)
        weights = np.where(swap[:, f.subset][..., None], (1 << m.weight_bits) - 1 - weights, weights)
    out = np.zeros((len(source), 128), np.int64)
    level, high = WEIGHT_RANGE[m.weight_bits]
    at = _put(out, 0, level >> 1 | (level & 1) << 4 | 2 << 5 | high << 9 | (m.planes - 1) << 10, 11)
    at = _put(out, at, m.subsets - 1, 2)
    if m.subsets > 1:
        at = _put(out, at, f.seed, 10)
        at = _put(out, at, ENDPOINT_MODE[m.components] << 2, 6)
    else:
        at = _put(out, at, ENDPOINT_MODE[m.components], 4)
    _endpoints(out, at, codes.reshape(len(source), -1), m.endpoint_range)
    flat = weights.reshape(len(source), -1)
    size = flat.shape[1] * m.weight_bits
    own = (flat[:, :, None] >> np.arange(m.weight_bits)) & 1
    out[:, 128 - size :] = own.reshape(len(source), size)[:, ::-1]  # weights run down from the top
    if m.planes == 2:
        _put(out, 128 - size - 2, f.second, 2)
    return out


def pack(blocks: np.ndarray) -> np.ndarray:
    """(n, 16) bytes of UASTC blocks (n, 16)."""
    out = np.zeros((len(blocks), 16), np.uint8)
    for k, here, bits in uastc.grouped(blocks):
        if k == uastc.SOLID:
            colour = np.stack([uastc.field(bits, uastc.MODES[k].size + 8 * c, 8) for c in range(4)], axis=1)
            out[here, :8] = np.frombuffer(VOID_EXTENT.to_bytes(8, "little"), np.uint8)
            out[here, 8:] = np.repeat(colour, 2, axis=1)
        else:
            out[here] = np.packbits(_laid_out(bits, k).astype(np.uint8), axis=1, bitorder="little")
    return out


#: HDR sources that are ASTC blocks already: block size and target.
HDR = {"UASTC_HDR_4x4": ((4, 4), "ASTC_HDR_4X4"), "ASTC_HDR_6x6": ((6, 6), "ASTC_HDR_6X6")}


def hdr_image(data: bytes, width: int, height: int, source: str, target: str) -> bytes:
    """The blocks of an HDR image, which pass as they are, or its texels."""
    (w, h), own = HDR[source]
    if len(data) != -(-width // w) * -(-height // h) * 16:
        raise ValueError("block data size mismatch")
    if target == own:
        return data
    from . import astc_hdr, bc6h

    if target == "BC6H":
        rgb = np.frombuffer(astc_hdr.image(data, width, height, (w, h), "RGB_HALF"), "<u2").reshape(height, width, 3)
        return bc6h.image(rgb)
    if target not in astc_hdr.TARGETS:
        raise ValueError(f"no way to {target} from {source}")
    return astc_hdr.image(data, width, height, (w, h), target)


def hdr_images(content: bytes, r: dict, target: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of a KTX2 container with HDR blocks."""
    from ..sources.ktx2 import block_images

    for k, level, w, h, data in block_images(content, r, HDR[r["texture_format"]][0]):
        yield k, level, w, h, hdr_image(data, w, h, r["texture_format"], target)
