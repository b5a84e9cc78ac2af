"""What UASTC blocks say of other formats: ETC1 halves, tables and a bias of the colours, EAC tables of alpha, and
whether BC1 can take the block's end points or weights. So these targets need no search."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import bc, etc1, packers, uastc

#: Changes of (first half, second half) in r, g, b that a bias means; others are the digits of the bias in base 3, less 1,
#: for both halves. Fixed values of the format.
BIASES = {
    2: ((-1, 0, 0), (0, 0, 0)), 5: ((0, -1, 0), (0, 0, 0)), 6: ((0, 0, -1), (0, 0, 0)), 7: ((1, 0, 0), (0, 0, 0)), 11: ((0, 1, 0), (0, 0, 0)), 15: ((0, 0, 1), (0, 0, 0)),
    18: ((0, 0, 0), (-1, 0, 0)), 19: ((0, 0, 0), (0, -1, 0)), 20: ((0, 0, 0), (0, 0, -1)), 21: ((0, 0, 0), (1, 0, 0)), 24: ((0, 0, 0), (0, 1, 0)), 8: ((0, 0, 0), (0, 0, 1)),
    10: ((-2, -2, -2), (-2, -2, -2)), 27: ((-1, -1, -1), (0, 0, 0)), 28: ((1, 1, 1), (-1, -1, -1)), 29: ((0, 0, 0), (1, 1, 1)), 30: ((0, 0, 0), (-1, -1, -1)), 31: ((1, 1, 1), (0, 0, 0)),
}
#: BC1 selector by weight, by the weights' bits. Fixed values of the format.
BC1_SELECTORS = {
    1: (0, 1), 2: (0, 2, 3, 1), 3: (0, 0, 2, 2, 3, 3, 1, 1), 4: (0, 0, 0, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 1, 1, 1),
    5: (0, 0, 0, 0, 0, 0, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 1, 1, 1, 1, 1, 1),
}
#: Fixed values of EAC: modifiers by table.
EAC = (
    (-3, -6, -9, -15, 2, 5, 8, 14), (-3, -7, -10, -13, 2, 6, 9, 12), (-2, -5, -8, -13, 1, 4, 7, 12), (-2, -4, -6, -13, 1, 3, 5, 12),
    (-3, -6, -8, -12, 2, 5, 7, 11), (-3, -7, -9, -11, 2, 6, 8, 10), (-4, -7, -8, -11, 3, 6, 7, 10), (-3, -5, -8, -11, 2, 4, 7, 10),
    (-2, -6, -8, -10, 1, 5, 7, 9), (-2, -5, -8, -10, 1, 4, 7, 9), (-2, -4, -8, -10, 1, 3, 7, 9), (-2, -5, -7, -10, 1, 4, 6, 9),
    (-3, -4, -7, -10, 2, 3, 6, 9), (-1, -2, -3, -10, 0, 1, 2, 9), (-4, -6, -8, -9, 3, 5, 7, 8), (-3, -5, -7, -9, 2, 4, 6, 8),
)
#: Luma of a texel, and of a tone against twice that.
TEXEL_LUMA, TONE_LUMA = np.array((108, 366, 38)), np.array((54, 183, 19))


def bias_table() -> np.ndarray:
    """(bias, half, channel)."""
    out = np.stack([np.arange(32) // 3**c % 3 - 1 for c in range(3)], 1)[:, None].repeat(2, 1)
    for bias, halves in BIASES.items():
        out[bias] = halves
    return out


@dataclass(frozen=True)
class Hints:
    """A field a block; those a mode hasn't are 0."""

    ends_fit: np.ndarray  # BC1 may take the end points
    weights_fit: np.ndarray  # BC1 may take the weights
    flip: np.ndarray
    differential: np.ndarray
    tables: np.ndarray  # (n, 2)
    bias: np.ndarray
    alpha: np.ndarray


def read(bits: np.ndarray, k: int) -> Hints:
    """Of blocks of mode k, that isn't the solid one. How many bits the hints have says which there are."""
    m = uastc.MODES[k]
    at, none = m.size, np.zeros(len(bits), np.int64)

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return uastc.field(bits, at - n, n)

    more = m.hints != 17
    ends, weights = take(1), take(1) if more else none
    flip, differential, tables = take(1), take(1), np.stack([take(3), take(3)], 1)
    return Hints(ends, weights, flip, differential, tables, take(5) if more else none, take(8) if m.hints > 15 else none)


def _biased(colour: np.ndarray, delta: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Colours moved by delta; at either end of the range the change is turned inwards."""
    moved = colour + delta
    moved = np.where((moved < 0) | (moved > most), colour - delta, moved)
    moved = np.where(colour == most, colour + delta - 1, moved)
    return np.where(colour == 0, np.where(delta == -2, 3, delta + 1), moved)


def _coded(rgb: np.ndarray, colours: np.ndarray, h: Hints) -> np.ndarray:
    """(n, 8) ETC1 bytes of colours (n, 2, 3) of the halves; selectors by the texels' luma."""
    c0, c1 = colours[:, 0], colours[:, 1]
    differs = h.differential[:, None] == 1
    delta = np.clip(c1 - c0, -4, 3)
    byte = np.where(differs, c0 << 3 | delta & 7, c0 << 4 | c1)
    head = byte[:, 0] << 24 | byte[:, 1] << 16 | byte[:, 2] << 8 | h.tables[:, 0] << 5 | h.tables[:, 1] << 2 | h.differential << 1 | h.flip
    second = np.where(differs, np.clip(c0 + delta, 0, 31), c1)
    base = np.stack([np.where(differs, v << 3 | v >> 2, v * 17) for v in (c0, second)], 1)  # n, 2, 3
    tones = np.clip(base[:, :, None] + etc1.MODIFIERS[h.tables][..., None], 0, 255) @ TONE_LUMA  # n, 2, 4
    steps = tones[:, :, 1:] + tones[:, :, :-1]
    side = np.where(h.flip[:, None] == 1, etc1.HALVES[1], etc1.HALVES[0])
    own = np.take_along_axis(steps, side[:, :, None], 1)
    selectors = 3 - (rgb @ TEXEL_LUMA < own.transpose(2, 0, 1)).sum(0)
    return etc1._bytes(head, selectors)


def etc1_colour(bits: np.ndarray, k: int, rgb: np.ndarray) -> np.ndarray:
    """(n, 8) ETC1 bytes of blocks of mode k with texels rgb (n, 16, 3)."""
    if k == uastc.SOLID:
        at = uastc.MODES[k].size + 32
        differential, table, selector, *colour = (uastc.field(bits, at + p, n) for p, n in ((0, 1), (1, 3), (4, 2), (6, 5), (11, 5), (16, 5)))
        byte = [np.where(differential == 1, c << 3, c << 4 | c) & 255 for c in colour]
        head = byte[0] << 24 | byte[1] << 16 | byte[2] << 8 | table << 5 | table << 2 | differential << 1
        return etc1._bytes(head, selector[:, None].repeat(16, 1))
    h = read(bits, k)
    most = np.where(h.differential == 1, 31, 15)[:, None, None]
    side = np.where(h.flip[:, None] == 1, etc1.HALVES[1], etc1.HALVES[0])
    sums = np.stack([np.where((side == s)[:, :, None], rgb, 0).sum(1) for s in (0, 1)], 1)
    colours = (sums * most + 1020) // 2040
    if uastc.MODES[k].hints != 17:
        colours = _biased(colours, bias_table()[h.bias], most)
    return _coded(rgb, colours, h)


def eac_alpha(bits: np.ndarray, k: int, alpha: np.ndarray) -> np.ndarray:
    """(n, 8) EAC bytes of the alpha (n, 16) of blocks of mode k."""
    lo, hi = alpha.min(1), alpha.max(1)
    out = packers.eac(lo[:, None].repeat(16, 1))
    if k != uastc.SOLID:
        out[:, 1] = 0x1D  # of one value, in these blocks
    uneven = np.flatnonzero(lo < hi)
    if not len(uneven):
        return out
    hint = read(bits[uneven], k).alpha
    multiplier = hint >> 4
    if (multiplier == 0).any():
        raise ValueError("invalid alpha hint")
    table = np.array(EAC)[hint & 15]
    least, most = table.min(1).astype(np.float32), table.max(1).astype(np.float32)
    low, high = lo[uneven].astype(np.float32), hi[uneven].astype(np.float32)
    centre = np.floor(low + (high - low) * (-least / (most - least)) + np.float32(0.5)).astype(np.int64)
    tones = np.clip(centre[:, None] + table * multiplier[:, None], 0, 255)
    best = (np.abs(tones[:, None] - alpha[uneven][:, :, None]) * 8 + np.arange(8)).min(2) & 7
    place = 45 - 12 * (np.arange(16) % 4) - 3 * (np.arange(16) // 4)
    word = (best << place).sum(1)
    out[uneven, 0], out[uneven, 1] = centre, multiplier << 4 | hint & 15
    for b in range(6):
        out[uneven, 2 + b] = word >> (40 - 8 * b) & 255
    return out


def bc1_colour(bits: np.ndarray, k: int, rgb: np.ndarray) -> np.ndarray:
    """(n, 8) BC1 bytes of blocks of mode k: with the block's own end points and weights where it says that they fit,
    else by search."""
    out = bc.bc1(rgb)
    if k == uastc.SOLID:
        return out
    f, h = uastc.fields(bits, k), read(bits, k)
    here = np.flatnonzero(h.ends_fit == 1)
    if not len(here):
        return out
    ends = uastc.endpoint_table(f.mode.endpoint_range)[f.codes[here, 0]]
    colour = ends[:, :3] if f.mode.components > 2 else ends[:, :1].repeat(3, 1)
    q = lambda v: (v[:, 0] * 31 + 127) // 255 << 11 | (v[:, 1] * 63 + 127) // 255 << 5 | (v[:, 2] * 31 + 127) // 255
    low, high = q(colour[..., 0]), q(colour[..., 1])
    selectors = np.array(BC1_SELECTORS[f.mode.weight_bits])[f.weights[here][:, :, 0]]
    swap = low < high
    selectors = np.where(swap[:, None], selectors ^ 1, selectors)
    first, second = np.maximum(low, high), np.minimum(low, high)
    same = first == second
    black = same & (first == 0)  # then the other colour is made the greater one
    selectors = np.where(same[:, None], np.where(black[:, None], 1, 0), selectors)
    first, second = np.where(black, 1, first), np.where(same & ~black, second - 1, second)
    word = first | second << 16 | (selectors << 32 + 2 * np.arange(16)).sum(1)
    out[here] = word.astype("<u8").view(np.uint8).reshape(-1, 8)
    return out


HINTED = {"ETC1": (etc1_colour,), "ETC2_NO_ALPHA": (etc1_colour,), "BC1": (bc1_colour,), "ETC2": (eac_alpha, etc1_colour), "BC3": (None, bc1_colour)}


def pack(blocks: np.ndarray, target: str) -> np.ndarray:
    """(n, 8 or 16) bytes of UASTC blocks (n, 16) in a target that they hold hints for."""
    parts = HINTED[target]
    texels = uastc.texels(blocks).astype(np.int64)
    out = np.zeros((len(blocks), 8 * len(parts)), np.uint8)
    for k, here, bits in uastc.grouped(blocks):
        for n, part in enumerate(parts):
            t = texels[here]
            if part is None:
                made = packers.bc4(t[..., 3])
            else:
                made = part(bits, k, t[..., 3] if part is eac_alpha else t[..., :3])
            out[here, 8 * n : 8 * n + 8] = made
    return out
