"""Packing of whole RGBA images, vectorised over texels or blocks. Edge blocks repeat the last row and column."""

from __future__ import annotations

import numpy as np

from ..operators.blocks import BC4_SELECTORS, EAC_TABLES, NARROW
from . import bc, etc1


def scale8(v: np.ndarray, most: int) -> np.ndarray:
    t = v.astype(np.int64) * most + 128
    return (t + (t >> 8)) >> 8


def pack16(rgba: np.ndarray, target: str) -> bytes:
    r, g, b, a = (rgba[..., c] for c in range(4))
    if target == "BGR565":
        r, b = b, r
    if target == "RGBA4444":
        out = scale8(r, 15) << 12 | scale8(g, 15) << 8 | scale8(b, 15) << 4 | scale8(a, 15)
    else:
        out = scale8(r, 31) << 11 | scale8(g, 63) << 5 | scale8(b, 31)
    return out.astype("<u2").tobytes()


def blocks(channel: np.ndarray) -> np.ndarray:
    """(blocks, 16) of an image's channel."""
    h, w = channel.shape
    padded = np.pad(channel, ((0, -h % 4), (0, -w % 4)), mode="edge").astype(np.int64)
    return padded.reshape(padded.shape[0] // 4, 4, -1, 4).transpose(0, 2, 1, 3).reshape(-1, 16)


def bc4(v: np.ndarray) -> np.ndarray:
    """(blocks, 8) bytes."""
    hi, lo = v.max(1), v.min(1)
    delta = (hi - lo)[:, None]
    reached = sum(((v - lo[:, None]) * 14 + 4 >= delta * k).astype(int) for k in (13, 11, 9, 7, 5, 3, 1))
    selectors = np.where(delta == 0, 0, np.array(BC4_SELECTORS)[reached])
    word = (selectors << 3 * np.arange(16)).sum(1)
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = hi, lo
    for k in range(6):
        out[:, 2 + k] = word >> 8 * k & 255
    return out


def eac(v: np.ndarray) -> np.ndarray:
    """(blocks, 8) bytes: base, multiplier and table, selectors column by column."""
    hi, lo = v.max(1), v.min(1)
    span = hi - lo
    place = 45 - 12 * (np.arange(16) % 4) - 3 * (np.arange(16) // 4)
    least = base = code = word = None
    for n, table in EAC_TABLES.items():
        wide = table[7] - table[3]
        own_base = np.clip(lo + (span * -2 * table[3] + wide) // (2 * wide), 0, 255)
        multiplier = np.clip((span * 2 + wide) // (2 * wide), 1, 15)
        value = own_base[:, None, None] + multiplier[:, None, None] * np.array(table)
        edge = ((v < 7) | (v > 248))[:, :, None]
        packed = (np.abs(np.where(edge, np.clip(value, 0, 255), value) - v[:, :, None]) * 8 + np.arange(8)).min(2)
        error = ((packed >> 3) ** 2).sum(1)
        bits = ((packed & 7) << place).sum(1)
        if least is None:
            least, base, code, word = error, own_base, multiplier * 16 + n, bits
        else:
            better = error < least
            least, base, code, word = (np.where(better, x, y) for x, y in ((error, least), (own_base, base), (multiplier * 16 + n, code), (bits, word)))
    low = np.clip(hi - 2, 0, 255)
    close = (np.array(NARROW)[np.clip(v - low[:, None] + 3, 0, 5)] << place).sum(1)
    flat, narrow = span == 0, span <= 5
    base = np.where(flat, lo, np.where(narrow, low, base))
    code = np.where(flat, 0x0D, np.where(narrow, 0x1D, code))
    word = np.where(flat, int((4 << place).sum()), np.where(narrow, close, word))
    out = np.zeros((len(v), 8), np.uint8)
    out[:, 0], out[:, 1] = base, code
    for k in range(6):
        out[:, 2 + k] = word >> (40 - 8 * k) & 255
    return out


PACKED = ("RGBA8", "RGB565", "BGR565", "RGBA4444", "BC1", "BC3", "BC4", "BC5", "BC7", "ETC1", "ETC2", "ETC2_NO_ALPHA", "ETC2_EAC_R11", "ETC2_EAC_RG11")
#: Blocks packed at a time; bounds the searches' arrays.
CHUNK = 4096


def _block_bytes(texels: np.ndarray, target: str) -> np.ndarray:
    """(n, 8 or 16) bytes of texels (n, 16, 4)."""
    rgb, red, alpha = texels[..., :3], texels[..., 0], texels[..., 3]
    if target == "BC7":
        return bc.pack_bc7(texels)
    parts = {
        "BC1": lambda: [bc.bc1(rgb)],
        "BC3": lambda: [bc4(alpha), bc.bc1(rgb)],
        "BC4": lambda: [bc4(red)],
        "BC5": lambda: [bc4(red), bc4(alpha)],
        "ETC1": lambda: [etc1.pack(rgb)],
        "ETC2_NO_ALPHA": lambda: [etc1.pack(rgb)],  # each ETC1 block means the same as an ETC2 one
        "ETC2": lambda: [eac(alpha), etc1.pack(rgb)],
        "ETC2_EAC_R11": lambda: [eac(red)],
        "ETC2_EAC_RG11": lambda: [eac(red), eac(alpha)],
    }[target]()
    return np.concatenate(parts, axis=1)


def pack(rgba: np.ndarray, target: str) -> bytes:
    if target == "RGBA8":
        return rgba.tobytes()
    if target.endswith("565") or target == "RGBA4444":
        return pack16(rgba, target)
    texels = np.stack([blocks(rgba[..., c]) for c in range(4)], axis=2)
    return b"".join(_block_bytes(texels[k : k + CHUNK], target).tobytes() for k in range(0, len(texels), CHUNK))


def finish(whole: np.ndarray, width: int, height: int, target: str) -> bytes:
    """A decoded image of whole blocks in the target format: pixels are cropped to the size, blocks are not."""
    cropped = target == "RGBA8" or target.endswith("565") or target == "RGBA4444"
    return pack(np.ascontiguousarray(whole[:height, :width]) if cropped else whole, target)
