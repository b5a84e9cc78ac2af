"""Blocks with given hints, against the format's rules worked out one block at a time."""

import numpy as np
import pytest

from texelflow.codecs import bc, etc1, uastc, uastc_hints
from texelflow.plans.written import BitWriter, uastc_block

MODES = [k for k in range(19) if k != uastc.SOLID]


def made(rng, k, ends_fit=0):
    m = uastc.MODES[k]
    levels = len(uastc.endpoint_table(m.endpoint_range))
    codes = [int(c) for c in rng.integers(levels, size=m.components * m.subsets * 2)]
    weights = rng.integers(1 << (m.weight_bits - 1), size=(16, m.planes)).tolist()
    w, h = BitWriter(), {"flip": int(rng.integers(2)), "diff": int(rng.integers(2)), "t": rng.integers(8, size=2).tolist(), "bias": 0, "alpha": 0}
    w.put(ends_fit, 1)
    if m.hints != 17:
        w.put(0, 1)
    w.put(h["flip"], 1)
    w.put(h["diff"], 1)
    for t in h["t"]:
        w.put(t, 3)
    if m.hints != 17:
        h["bias"] = int(rng.integers(32))
        w.put(h["bias"], 5)
    if m.hints > 15:
        h["alpha"] = int(rng.integers(1, 16)) << 4 | int(rng.integers(16))
        w.put(h["alpha"], 8)
    patterns = {0: 1, 4: 11}.get(m.pattern_bits, 19)
    return uastc_block(k, int(rng.integers(patterns)), codes, weights, int(rng.integers(4)), w.value), h, codes, weights


def changed(v, d, most):
    if v == 0:
        return 3 if d == -2 else d + 1
    if v == most:
        return v + d - 1
    return v + d if 0 <= v + d <= most else v - d


@pytest.mark.parametrize("k", MODES)
def test_etc1(k):
    rng = np.random.default_rng(k)
    blocks, hints, _, _ = zip(*[made(rng, k) for _ in range(40)], strict=True)
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)
    texels, out = uastc.texels(raw).astype(int), uastc_hints.pack(raw, "ETC1")
    bias = uastc_hints.bias_table()
    for t, b, h in zip(texels, out, hints, strict=True):
        most = 31 if h["diff"] else 15
        colours = []
        for s in (0, 1):
            own = t[etc1.HALVES[h["flip"]] == s, :3].sum(0)
            c = [(int(x) * most + 1020) // 2040 for x in own]
            if uastc.MODES[k].hints != 17:
                c = [changed(x, int(d), most) for x, d in zip(c, bias[h["bias"]][s], strict=True)]
            colours.append(c)
        for c in range(3):
            d = max(-4, min(3, colours[1][c] - colours[0][c]))
            assert b[c] == (colours[0][c] << 3 | d & 7 if h["diff"] else colours[0][c] << 4 | colours[1][c])
        assert b[3] == h["flip"] | h["diff"] << 1 | h["t"][0] << 5 | h["t"][1] << 2
    # the selector's tone is the nearest by luma
    luma = np.array((54, 183, 19))
    shown = etc1.texels(out).astype(int) @ luma
    word = out.copy()
    every = []
    for code in range(4):
        word[:, 4:6], word[:, 6:8] = 255 * (code >> 1), 255 * (code & 1)
        every.append(etc1.texels(word).astype(int) @ luma)
    want = texels[..., :3] @ luma
    assert (np.abs(shown - want) == np.abs(np.array(every) - want).min(0)).all()


@pytest.mark.parametrize("k", [k for k in MODES if uastc.MODES[k].hints > 15])
def test_eac_alpha(k):
    rng = np.random.default_rng(k)
    blocks, hints, _, _ = zip(*[made(rng, k) for _ in range(40)], strict=True)
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)
    alpha, out = uastc.texels(raw)[..., 3].astype(int), uastc_hints.pack(raw, "ETC2")
    for a, b, h in zip(alpha, out, hints, strict=True):
        if a.min() == a.max():
            assert (b[0], b[1]) == (a[0], 0x1D)
            continue
        table, mul = uastc_hints.EAC[h["alpha"] & 15], h["alpha"] >> 4
        assert b[1] == h["alpha"] and abs(int(b[0]) - (a.min() + (a.max() - a.min()) * -min(table) / (max(table) - min(table)))) <= 0.5 + 1e-4
        word = int.from_bytes(b[2:8].tobytes(), "big")
        for i in range(16):
            x, y = i % 4, i // 4
            tones = [max(0, min(255, int(b[0]) + m * mul)) for m in table]
            assert abs(tones[word >> (45 - 12 * x - 3 * y) & 7] - a[i]) == min(abs(t - a[i]) for t in tones)


@pytest.mark.parametrize("k", MODES)
def test_bc1_of_end_points(k):
    rng = np.random.default_rng(k)
    blocks, _, codes, weights = zip(*[made(rng, k, 1) for _ in range(30)], strict=True)
    raw = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 16)
    out = uastc_hints.pack(raw, "BC1")
    m = uastc.MODES[k]
    values = uastc.endpoint_table(m.endpoint_range)
    for b, c, w in zip(out, codes, weights, strict=True):
        ends = []
        for j in (0, 1):
            r, g, bl = (int(values[c[2 * min(n, m.components - 1 if m.components > 2 else 0) + j]]) for n in range(3))
            ends.append((r * 31 + 127) // 255 << 11 | (g * 63 + 127) // 255 << 5 | (bl * 31 + 127) // 255)
        first, second = (int.from_bytes(b[p : p + 2].tobytes(), "little") for p in (0, 2))
        if ends[0] == ends[1]:
            assert (first, second) == ((1, 0) if not ends[0] else (ends[0], ends[0] - 1))
            continue
        assert (first, second) == (max(ends), min(ends))
        selectors = int.from_bytes(b[4:8].tobytes(), "little")
        for t in range(16):
            s = uastc_hints.BC1_SELECTORS[m.weight_bits][w[t][0]]
            assert selectors >> (2 * t) & 3 == (s ^ 1 if ends[0] < ends[1] else s)


def test_solid_and_bc3():
    w = BitWriter()
    for v, n in ((0x17, 5), (200, 8), (100, 8), (50, 8), (77, 8), (1, 1), (5, 3), (2, 2), (20, 5), (10, 5), (5, 5)):
        w.put(v, n)
    raw = np.frombuffer(w.done().ljust(16, b"\0"), np.uint8).reshape(1, 16)
    assert uastc_hints.pack(raw, "ETC1")[0].tolist() == [20 << 3, 10 << 3, 5 << 3, 2 | 5 << 5 | 5 << 2, 0, 0, 0, 0]
    assert uastc_hints.pack(raw, "ETC2")[0, :2].tolist() == [77, 0x0D]
    bc3 = uastc_hints.pack(raw, "BC3")
    assert bc3[0, 0] == 77 and np.abs(bc.bc1_texels(bc3[:, 8:], four=True).astype(int) - (200, 100, 50)).max() <= 4
