"""Blocks read one by one with a decoder of the layout, against the texels of their source."""

import numpy as np
from test_uastc import made, put

from texelflow.codecs import astc, uastc


def weight_and_endpoint_reader(block):
    word = int.from_bytes(bytes(block), "little")
    take = lambda at, n: word >> at & ((1 << n) - 1)
    if take(0, 9) == 0x1FC:
        return np.array([[take(64 + 16 * c, 16) >> 8 for c in range(4)]] * 16)
    mode = take(0, 11)
    assert mode >> 2 & 3 == 0 and mode >> 5 & 3 == 2 and mode >> 7 & 3 == 0  # a grid of 4 x 4
    level = (mode & 3) << 1 | mode >> 4 & 1
    weight_bits = {(2, 0): 1, (4, 0): 2, (7, 0): 3, (4, 1): 4, (7, 1): 5}[level, mode >> 9 & 1]
    planes, parts = 1 + (mode >> 10 & 1), 1 + take(11, 2)
    if parts == 1:
        cem, at, subset = take(13, 4), 17, [0] * 16
    else:
        assert take(23, 2) == 0
        cem, at, subset = take(25, 4), 29, uastc.partition(take(13, 10), parts)
    comps = {4: 2, 8: 3, 12: 4}[cem]
    n = comps * 2 * parts
    weights = []
    for k in range(16 * planes):
        own = [word >> (127 - k * weight_bits - j) & 1 for j in range(weight_bits)]
        weights.append(sum(b << j for j, b in enumerate(own)))
    second = take(128 - 16 * planes * weight_bits - 2, 2) if planes == 2 else None
    room = 128 - 16 * planes * weight_bits - (2 if planes == 2 else 0) - at

    def size(r):
        b, t, q = uastc.RANGES[r]
        return n * b + -(-8 * n * t // 5) + -(-7 * n * q // 3)

    r = max(k for k in range(4, 21) if size(k) <= room)  # the greatest range that fits is the one meant
    low, trits, quints = uastc.RANGES[r]
    codes = []
    while len(codes) < n:
        if not trits and not quints:
            codes.append(take(at, low))
            at += low
            continue
        cuts, digits, radix = ((2, 2, 1, 2, 1), astc._trits, 3) if trits else ((3, 2, 2), astc._quints, 5)
        own, code, shift = [], 0, 0
        for cut in cuts[: n - len(codes)]:
            own.append(take(at, low))
            code |= take(at + low, cut) << shift
            at, shift = at + low + cut, shift + cut
        codes += [d << low | v for d, v in zip(digits(code), own, strict=False)]
        assert radix > max(digits(code))
    ends = uastc.endpoint_table(r)[codes].reshape(parts, comps, 2)
    scale, out = uastc.weight_table(weight_bits), np.full((16, 4), 255)
    for t in range(16):
        lo, hi = ends[subset[t], :, 0], ends[subset[t], :, 1]
        if comps > 2:
            assert hi[:3].sum() >= lo[:3].sum()  # no blue contraction
        for c in range(4):
            src = c if comps > 2 else int(c == 3)
            if src < comps:
                w = int(scale[weights[t * planes + (second == c)]])
                out[t, c] = (int(lo[src]) * 257 * (64 - w) + int(hi[src]) * 257 * w + 32) >> 14
    return out


def test_all_modes():
    rng = np.random.default_rng(16)
    blocks = [made(rng, k)[0] for k in range(19) if k != uastc.SOLID for _ in range(20)]
    blocks.append(put([(0x17, 5), (1, 8), (2, 8), (3, 8), (4, 8)]))
    source = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)
    for block, want in zip(astc.pack(source), uastc.texels(source), strict=True):
        assert (weight_and_endpoint_reader(block) == want).all()


def test_bundles_are_complete():
    for radix, n, decode in ((3, 5, astc._trits), (5, 3, astc._quints)):
        for value, code in enumerate(astc.bundle_codes(radix)):
            assert list(decode(int(code))) == [value // radix**k % radix for k in range(n)]
