"""Streams written here, and their physical blocks read by the decoder of that layout."""

import numpy as np
import pytest

from texelflow.codecs import astc_hdr, hdr6x6i, uastc
from texelflow.plans.written import BitWriter

FINE = [k for k, m in enumerate(hdr6x6i.MODES) if m[2] != 2]


class Stream(BitWriter):
    def __init__(self, width, height, signature=0xABCE):
        super().__init__()
        for v in (signature, width, height):
            self.put(v, 16)

    def codes(self, codes, r):
        bits, trits, quints = uastc.RANGES[r]
        radix = 3 if trits else 5 if quints else 1
        if radix > 1:
            sizes = uastc.TAILS[radix]
            step = len(sizes) - 1
            for at in range(0, len(codes), step):
                own = [c >> bits for c in codes[at : at + step]]
                self.put(sum(v * radix**j for j, v in enumerate(own)), sizes[len(own)])
        for c in codes:
            self.put(c, bits)

    def coded(self, mode, how, ends=(), weights=(), pattern=0, deltas=()):
        self.put(1, 1)
        self.truncated(mode, 75)
        self.truncated(how, 5)
        m = hdr6x6i.MODES[mode]
        if how == 0:
            if m[2] > 1:
                self.truncated(pattern, len(hdr6x6i.seeds(m[2])))
            self.codes(ends, m[5])
        for d in deltas:
            self.put(d + 16, 5)
        self.codes(weights, m[6])

    def end(self):
        self.put(hdr6x6i.END, 16)
        return self.done()


def drawn(rng, mode):
    dual, kind, groups, w, h, e, q, *_ = hdr6x6i.MODES[mode]
    ends = rng.integers(len(uastc.endpoint_table(e)), size=hdr6x6i.VALUES[kind] * groups).tolist()
    return ends, rng.integers(len(hdr6x6i._weights(q)), size=w * h * (1 + dual)).tolist()


def expected(mode, ends, weights, seed=0):
    """(36, 3) halves, from the values themselves."""
    dual, kind, groups, w, h, e, q, e2, q2, second = hdr6x6i.MODES[mode]
    assert (e, q) == (e2, q2)
    n = hdr6x6i.VALUES[kind]
    values = uastc.endpoint_table(e)[np.array(ends)].reshape(groups, n)
    pairs = np.concatenate([astc_hdr.ends_of(v[None], kind)[0] for v in values])
    grid = hdr6x6i._weights(q)[np.array(weights)].reshape(1, w * h, 1 + dual)
    spread = astc_hdr._spread(grid, (w, h), (6, 6))[0]
    out = np.zeros((36, 3), int)
    group = astc_hdr.subsets(seed, groups, 6, 6)
    for t in range(36):
        for c in range(3):
            x = spread[t, 1 if dual and c == second else 0]
            out[t, c] = (pairs[group[t], c, 0] * (64 - x) + pairs[group[t], c, 1] * x + 32) >> 6
    return astc_hdr._hdr_half(out)


def texels(blocks):
    return astc_hdr.halves(np.frombuffer(blocks, np.uint8).reshape(-1, 16), (6, 6))[..., :3]


def test_patterns():
    assert [len(hdr6x6i.seeds(k)) for k in (2, 3)] == [521, 333] and len(hdr6x6i.MODES) == 75
    assert [hdr6x6i.near(k) for k in (0, 3, 4, 11, 12, 31)] == [(-1, 0), (-4, 0), (3, -1), (-4, -1), (3, -2), (0, -4)]


@pytest.mark.parametrize("mode", [k for k in FINE if hdr6x6i.MODES[k][5:7] == hdr6x6i.MODES[k][7:9] and hdr6x6i.MODES[k][3:5] != (2, 2)])
def test_coded_blocks(mode):
    rng = np.random.default_rng(mode)
    for _ in range(4):
        ends, weights = drawn(rng, mode)
        pattern = int(rng.integers(333))
        s = Stream(6, 6)
        s.coded(mode, 0, ends, weights, pattern)
        got = texels(hdr6x6i.blocks(s.end(), 6, 6))[0]
        seed = hdr6x6i.seeds(3)[pattern] if hdr6x6i.MODES[mode][2] == 3 else 0
        assert (got == expected(mode, ends, weights, seed)).all()


def test_two_groups_need_their_order():
    mode = next(k for k, m in enumerate(hdr6x6i.MODES) if m[2] == 2)
    ends, weights = drawn(np.random.default_rng(1), mode)
    s = Stream(6, 6)
    s.coded(mode, 0, ends, weights, 7)
    data = s.end()
    with pytest.raises(ValueError, match="order"):
        hdr6x6i.blocks(data, 6, 6)
    order = hdr6x6i.seeds(2)[::-1]
    assert (texels(hdr6x6i.blocks(data, 6, 6, order))[0] == expected(mode, ends, weights, order[7])).all()


def test_other_kinds_of_blocks():
    rng = np.random.default_rng(2)
    _, weights = drawn(rng, 1)
    ranks = np.argsort(uastc.endpoint_table(hdr6x6i.MODES[1][5]))
    ends = [int(c) for c in ranks[rng.integers(4, len(ranks) - 4, size=6)]]  # so that differences stay in range
    again = [drawn(rng, 1)[1] for _ in range(3)]
    s = Stream(24, 12)  # four blocks in a row
    s.coded(1, 0, ends, weights)
    s.put(0b000, 3)  # a run of two
    s.chunked(1, 5)
    s.put(0b100, 3)  # one colour
    for v in (100, 200, 300):
        s.put(v, 15)
    s.put(0b10, 2)  # all but the weights of the block above, then of the third to the left
    s.put(7, 5)
    s.codes(again[0], hdr6x6i.MODES[1][6])
    s.coded(1, 1, weights=again[1])  # the left one's end points
    s.coded(1, 2, weights=again[2])  # the upper one's
    s.coded(1, 3, weights=again[2], deltas=(0, 1, -1, 0, 2, 0))
    got = texels(hdr6x6i.blocks(s.end(), 24, 12))
    own = [weights, weights, weights, None, again[0], again[1], again[2]]
    for k, w in enumerate(own):
        assert (got[k] == ((100, 200, 300) if w is None else expected(1, ends, w))).all()
    table = uastc.endpoint_table(hdr6x6i.MODES[1][5])
    order = np.argsort(table)
    moved = [int(order[int(np.flatnonzero(order == c)[0]) + d]) for c, d in zip(ends, (0, 1, -1, 0, 2, 0), strict=True)]
    assert (got[7] == expected(1, moved, again[2])).all()


def test_changed_ranges():
    """Modes with a 2 x 2 grid: weights are spread, and end points keep the bits that choose the layout."""
    rng = np.random.default_rng(3)
    for mode in [k for k in FINE if hdr6x6i.MODES[k][3:5] == (2, 2)]:
        m = hdr6x6i.MODES[mode]
        ends, weights = drawn(rng, mode)
        s = Stream(6, 6)
        s.coded(mode, 0, ends, weights)
        got = texels(hdr6x6i.blocks(s.end(), 6, 6))[0]
        values = uastc.endpoint_table(m[5])[np.array(ends)]
        pairs = astc_hdr.ends_of(values[None], m[1])[0][0]
        if m[7] == 20:  # no end point is changed
            lo, hi = astc_hdr._hdr_half(pairs.min(1)), astc_hdr._hdr_half(pairs.max(1))
            assert (got >= lo[:3]).all() and (got <= hi[:3]).all()
    table = uastc.endpoint_table(10)
    for v in range(256):
        code = hdr6x6i._nearest(table, v, 0xC0)
        assert table[code] & 0xC0 == v & 0xC0


@pytest.mark.parametrize("cut", [1, 4, 9])
def test_faults(cut):
    ends, weights = drawn(np.random.default_rng(4), 1)
    s = Stream(12, 6)
    s.coded(1, 0, ends, weights)
    with pytest.raises(ValueError):
        hdr6x6i.blocks(s.done()[:-cut], 12, 6)
    with pytest.raises(ValueError):
        hdr6x6i.blocks(s.done(), 6, 6)
    first = Stream(6, 6)
    first.put(0b000, 3)
    first.chunked(0, 5)
    with pytest.raises(ValueError):
        hdr6x6i.blocks(first.end(), 6, 6)
