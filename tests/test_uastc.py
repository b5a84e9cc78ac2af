import numpy as np
import pytest
from test_ktx2 import container

from texelflow.codecs import uastc
from texelflow.sources import ktx2
import struct


def put(fields):
    value = at = 0
    for v, n in fields:
        value |= (int(v) & ((1 << n) - 1)) << at
        at += n
    assert at <= 128
    return value.to_bytes(16, "little")


def made(rng, k):
    """A block of mode k with known fields, and its texels worked out one by one."""
    m = uastc.MODES[k]
    seeds = uastc.SEEDS_7 if k == 7 else uastc.SEEDS_3 if m.subsets == 3 else uastc.SEEDS_2
    pattern = int(rng.integers(len(seeds))) if m.pattern_bits else 0
    subset = uastc.partition(seeds[pattern], m.subsets) if m.pattern_bits else [0] * 16
    ccs = int(rng.integers(4)) if m.selector_bits else 3
    bits, trits, quints = uastc.RANGES[m.endpoint_range]
    radix = 3 if trits else 5 if quints else 1
    n = m.components * 2 * m.subsets
    codes = [int(c) for c in rng.integers(radix << bits, size=n)]
    fields = [(m.code, m.size), (rng.integers(1 << m.hints), m.hints), (pattern, m.pattern_bits), (ccs, m.selector_bits)]
    if radix > 1:
        step, sizes = (5, (2, 4, 5, 7, 8)) if trits else (3, (3, 5, 7))
        for a in range(0, n, step):
            own = [c >> bits for c in codes[a : a + step]]
            fields.append((sum(v * radix**j for j, v in enumerate(own)), sizes[len(own) - 1]))
    fields += [(c & ((1 << bits) - 1), bits) for c in codes]
    firsts = {list(subset).index(s) for s in range(m.subsets)}
    weights = []
    for t in range(16):
        for _ in range(m.planes):
            size = m.weight_bits - (t in firsts)
            weights.append(int(rng.integers(1 << size)))
            fields.append((weights[-1], size))
    values, scale = uastc.endpoint_table(m.endpoint_range), uastc.weight_table(m.weight_bits)
    want = np.full((16, 4), 255)
    for t in range(16):
        for c in range(4):
            own = c if m.components > 2 else int(c == 3)
            if own >= m.components:
                continue
            at = (subset[t] * m.components + own) * 2
            w = int(scale[weights[t * m.planes + (m.planes == 2 and c == ccs)]])
            lo, hi = (int(values[codes[at + j]]) for j in range(2))
            want[t, c] = ((lo * 257) * (64 - w) + hi * 257 * w + 32) >> 14
    return put(fields), want


def test_all_modes():
    rng = np.random.default_rng(6)
    blocks, want = zip(*[made(rng, k) for k in range(19) if k != uastc.SOLID for _ in range(12)], strict=True)
    got = uastc.texels(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16))
    assert (got == np.array(want)).all()


def test_solid_and_reserved(spark):
    solid = put([(0x17, 5), (1, 8), (2, 8), (3, 8), (4, 8)])
    assert (uastc.texels(np.frombuffer(solid, np.uint8).reshape(1, 16)) == [1, 2, 3, 4]).all()
    with pytest.raises(ValueError):
        uastc.texels(np.frombuffer(bytes([0x45] + [0] * 15), np.uint8).reshape(1, 16))
    dfd = struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", 166 | 1 << 8 | 1 << 16, 3 | 3 << 8) + bytes(24)
    good, bad = container([solid * 4, solid], 0, 0, 6, 5, dfd=dfd), container([solid[:-1]], 0, 0, 4, 4, dfd=dfd)
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad))], "path string, content binary")
    rows = uastc.decoded(ktx2.descriptors(ktx2.headers(df))).collect()
    assert [(r["level"], r["width"], r["height"], bytes(r["rgba"] or b"")) for r in rows if r["path"] == "a"] == [(0, 6, 5, bytes([1, 2, 3, 4]) * 30), (1, 3, 2, bytes([1, 2, 3, 4]) * 6)]
    assert [r["error"] for r in rows if r["path"] == "b"] == ["UASTC block data size mismatch"]


def test_tables():
    assert [int(uastc.endpoint_table(r)[-1 if not any(uastc.RANGES[r][1:]) else 0]) for r in (5, 8, 11, 14, 17)] == [255] * 5
    assert uastc.weight_table(2).tolist() == [0, 21, 43, 64] and uastc.weight_table(1).tolist() == [0, 64]
    for r in range(4, 21):
        t = uastc.endpoint_table(r)
        assert t.min() == 0 and t.max() == 255 and len(set(t.tolist())) == len(t)
