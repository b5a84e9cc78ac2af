"""Round trips of streams written here."""

import struct

import numpy as np
import pytest

from texelflow.codecs import etc1s
from texelflow.codecs.bits import LENGTH_ORDER
from texelflow.sources import ktx2


class Writer:
    def __init__(self):
        self.value = self.at = 0

    def put(self, v, n):
        self.value |= v << self.at
        self.at += n

    def done(self):
        return self.value.to_bytes(-(-self.at // 8), "little")

    def flat(self, symbols):
        """A table of `symbols` codes of one length, stored; gives the writer of a symbol."""
        n = max(1, (symbols - 1).bit_length())
        self.put(symbols, 14)
        self.put(len(LENGTH_ORDER), 5)
        for place in LENGTH_ORDER:
            self.put(1 if place in (n, 0) else 0, 3)
        for _ in range(symbols):
            self.put(1 if n > 0 else 0, 1)  # of the two codes, 0 is the shorter length's
        return lambda w, s: w.put(int(f"{s:0{n}b}"[::-1], 2), n)


def book_bytes(ends, sels, history=4):
    w = Writer()
    tables = [w.flat(32) for _ in range(3)]
    level = w.flat(8)
    w.put(0, 1)
    last, inten = [16] * 3, 0
    for *rgb, i in ends:
        level(w, (i - inten) & 7)
        inten = i
        for c in range(3):
            tables[sum(last[c] > s for s in (9, 21))](w, (rgb[c] - last[c]) & 31)
            last[c] = rgb[c]
    v = Writer()
    v.put(0b100, 3)
    for row in sels.reshape(-1, 4, 4):
        for line in row:
            v.put(int(sum(int(x) << 2 * k for k, x in enumerate(line))), 8)
    t = Writer()
    codes = [t.flat(257), t.flat(len(ends)), t.flat(len(sels) + history + 1), t.flat(64)]
    t.put(history, 13)
    return w.done(), v.done(), t.done(), codes


def stream(e, s, n_end, n_sel, history, codes, runs=True):
    """All endpoints coded as deltas, all selectors as symbols, but for runs and one use of the history."""
    ny, nx = e.shape
    w, last, flat, k = Writer(), 0, s.reshape(-1), 0
    pending = 0
    for y in range(ny):
        for x in range(nx):
            if not (x | y) & 1 and pending == 0:
                codes[0](w, 0xFF)
                if runs and (x, y) == (0, 0) and ((nx + 1) // 2) * ((ny + 1) // 2) >= 4:
                    pending = -1
            elif not (x | y) & 1 and pending == -1:
                codes[0](w, 256)  # repeat the last symbol three times
                w.put(0, 5)
                pending = 2
            elif not (x | y) & 1:
                pending -= 1
            codes[1](w, int(e[y, x] - last) % n_end)
            last = e[y, x]
            if k:
                k -= 1
                continue
            i = y * nx + x
            codes[2](w, int(flat[i]))
    return w.done()


@pytest.fixture
def made():
    rng = np.random.default_rng(8)
    ends = [(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(*rng.integers(0, 32, (3, 9)), rng.integers(0, 8, 9), strict=True)]
    return rng, ends, rng.integers(0, 4, (7, 16))


def test_palettes(made):
    _, ends, sels = made
    a, b, t, _ = book_bytes(ends, sels)
    book = etc1s.codebook(a, len(ends), b, len(sels), t)
    assert book.endpoints.tolist() == [list(x) for x in ends] and (book.selectors == sels).all() and book.history == 4


def test_streams_and_colours(spark, made):
    rng, ends, sels = made
    a, b, t, codes = book_bytes(ends, sels)
    book = etc1s.codebook(a, len(ends), b, len(sels), t)
    e, s = rng.integers(0, 9, (4, 5)), rng.integers(0, 7, (4, 5))
    data = stream(e, s, 9, 7, 4, codes)
    got = etc1s.blocks(data, book, 5, 4)
    assert (got[0] == e).all() and (got[1] == s).all()
    rgba = etc1s.colours(e, s, book, 18, 15)
    assert rgba.shape == (15, 18, 4)
    y, x = 6, 9
    r5, _, _, i = ends[e[1, 2]]
    want = (r5 << 3 | r5 >> 2) + etc1s.ETC1_MODIFIERS[i][sels[s[1, 2]][(y % 4) * 4 + x % 4]]
    assert rgba[y, x, 0] == min(255, max(0, want))
    # the same as a container with an alpha slice
    sgd = struct.pack("<2H4I", 9, 7, len(a), len(b), len(t), 0) + struct.pack("<5I", 0, 0, len(data), 0, len(data)) + a + b + t
    dfd = struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", 163 | 1 << 8 | 2 << 16, 3 | 3 << 8) + bytes(24)
    at = 104
    head = bytes.fromhex(ktx2.IDENTIFIER) + struct.pack("<13I2Q", 0, 1, 18, 15, 0, 0, 1, 1, 1, at, 44, 0, 0, at + 44, len(sgd))
    content = head + struct.pack("<3Q", at + 44 + len(sgd), len(data), 0) + dfd + sgd + data
    df = spark.createDataFrame([("f", bytearray(content)), ("cut", bytearray(content[:140] + bytes(200)))], "path string, content binary")
    rows = {r["path"]: r for r in etc1s.decoded(ktx2.descriptors(ktx2.headers(df))).collect()}
    out = np.frombuffer(bytes(rows["f"]["rgba"]), np.uint8).reshape(15, 18, 4)
    assert (out[..., :3] == rgba[..., :3]).all() and (out[..., 3] == rgba[..., 0]).all()
    assert "cut" not in rows or rows["cut"]["error"]


def test_history_and_video(made):
    _, ends, sels = made
    a, b, t, codes = book_bytes(ends, sels)
    book = etc1s.codebook(a, 9, b, 7, t)
    w = Writer()
    codes[0](w, 0xFF)
    for k, (delta, symbol) in enumerate(((2, 5), (0, 7 + 4), (1, None), (0, None))):  # a selector, then a run of the history's first
        codes[1](w, delta)
        if symbol is not None:
            codes[2](w, symbol)
        if symbol == 11:
            codes[3](w, 0)
    e, s = etc1s.blocks(w.done(), book, 2, 2)
    assert e.tolist() == [[2, 2], [3, 3]] and s.tolist() == [[5, 0], [0, 0]]
    v = Writer()
    codes[0](v, 0b10101010)  # all from the frame before
    assert [x.tolist() for x in etc1s.blocks(v.done(), book, 2, 2, (e, s))] == [e.tolist(), s.tolist()]
    bad = Writer()
    codes[0](bad, 0)
    with pytest.raises(ValueError):
        etc1s.blocks(bad.done(), book, 2, 2)
