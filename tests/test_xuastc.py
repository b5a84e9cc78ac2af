import struct

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from texelflow.codecs import xuastc
from texelflow.plans.written import BitWriter


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 2**16)), max_size=400), st.integers(2, 300), st.booleans())
def test_streams_of_all_codes(items, n, quick):
    def models():
        return xuastc.SymbolModel(n, quick), xuastc.BitModel(), xuastc.GammaModel()

    e, (symbols, bit, gamma) = xuastc.Encoder(), models()
    for kind, v in items:
        [lambda: e.bits(v % 1024, 10), lambda: e.bit(v % 7 == 0, bit), lambda: e.symbol(v * v % n, symbols), lambda: e.gamma(1 + v, gamma), lambda: e.truncated(v % n, n), lambda: e.rice(v % 500, 4)][kind]()
    d, (symbols, bit, gamma) = xuastc.Decoder(e.done()), models()
    for kind, v in items:
        want, got = [(v % 1024, lambda: d.bits(10)), (v % 7 == 0, lambda: d.bit(bit)), (v * v % n, lambda: d.symbol(symbols)), (1 + v, lambda: d.gamma(gamma)), (v % n, lambda: d.truncated(n)), (v % 500, lambda: d.rice(4))][kind]
        assert got() == want


def test_models_adapt_and_are_halved():
    m = xuastc.SymbolModel(4)
    for _ in range(40_000):
        m.seen(2)
    assert sum(m.counts) < 1 << xuastc.SYMBOL_SHIFT and m.starts[3] - m.starts[2] > 0.99 * (1 << xuastc.SYMBOL_SHIFT)
    b = xuastc.BitModel()
    for _ in range(20_000):
        b.seen(0)
    assert b.share > 0.99 * (1 << xuastc.BIT_SHIFT) and b.zeros < b.all < 1 << xuastc.BIT_SHIFT


FIELDS = ((1, 5), (4, 4), (1, 1), (300, 16), (200, 16), (1, 1), (1, 1), (151, 8))


def payloads():
    w, e = BitWriter(), xuastc.Encoder()
    for v, n in FIELDS:
        w.put(v, n)
        e.bits(v, n)
    raw, arith = w.done(), e.done()
    frame = zstandard.compress(b"modes" * 9)
    sizes = [len(raw), len(frame)] + [0] * 13 + [3] + [0] * 5
    return {"FULL_ARITH": b"\0" + arith, "HYBRID_ARITH_ZSTD": b"\1" + struct.pack("<11I", len(arith), *[0] * 10) + arith, "FULL_ZSTD": b"\2" + struct.pack("<21I", *sizes) + raw + frame + b"abc"}


@pytest.mark.parametrize("kind", xuastc.SYNTAXES)
def test_headers(kind):
    data = payloads()[kind]
    h = xuastc.header(data)
    assert h == xuastc.Header(kind, (6, 6), True, 300, 200, True, 75.5)
    with pytest.raises(ValueError, match="not supported" if kind.startswith("HYBRID") else "not decoded"):
        xuastc.blocks(data)
    with pytest.raises(ValueError):
        xuastc.header(data[:3])
    with pytest.raises(ValueError):
        xuastc.header(b"\3" + data[1:])


def test_sections():
    data = payloads()["FULL_ZSTD"]
    found = xuastc.sections(data)
    assert list(found) == list(xuastc.SECTIONS)
    at, n, full = found["modes"]
    assert full == 45 and zstandard.decompress(data[at : at + n]) == b"modes" * 9
    assert found["signs"][1:] == (3, 3) and data[found["signs"][0] :] == b"abc" and found["dpcm3"][1:] == (0, 0)
    with pytest.raises(ValueError):
        xuastc.lengths(data[:-1])
    assert np.prod([len(xuastc.SECTIONS), len(xuastc.SIZES)]) == 280
