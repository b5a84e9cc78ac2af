import numpy as np
from test_uastc import made

from texelflow.codecs import astc, astc_hdr, uastc


def half(v):
    return int(np.float16(v).view(np.uint16))


def test_ldr_blocks_agree_with_their_source():
    rng = np.random.default_rng(26)
    source = np.frombuffer(b"".join(made(rng, k)[0] for k in range(19) if k != uastc.SOLID for _ in range(15)), np.uint8).reshape(-1, 16)
    got = astc_hdr.halves(astc.pack(source), (4, 4)).astype(np.uint16).view(np.float16).astype(float)
    assert (np.floor(got * 256 + 1e-6).clip(0, 255) - uastc.texels(source) <= 0).all() and np.abs(got * 255 - uastc.texels(source)).max() < 1.2


def test_void_extents_and_faults():
    hdr = np.frombuffer((0xFFFFFFFFFFFFFFFC).to_bytes(8, "little") + np.array([0x3C00, 1, 2, 0x7BFF], "<u2").tobytes(), np.uint8)
    got = astc_hdr.halves(np.stack([hdr, np.zeros(16, np.uint8)]), (6, 6))
    assert (got[0] == [0x3C00, 1, 2, 0x7BFF]).all() and (got[1] == 0xFFFF).all()


def test_hdr_end_points():
    ends = lambda kind, *v: astc_hdr.ends_of(np.array([v]), kind)[0][0] >> 4
    assert ends(2, 10, 20)[0].tolist() == [160, 320] and ends(2, 20, 10)[0].tolist() == [168, 312]
    assert ends(3, 0x05, 0x23)[0].tolist() == [0x20A, 0x210] and ends(3, 0x85, 0x23)[0].tolist() == [0x214, 0x220]
    assert ends(11, 1, 2, 3, 4, 0x85, 0x86).tolist() == [[16, 32], [48, 64], [160, 192], [0x780, 0x780]]
    # mode 0, red the major: a = 100, c = 10, b0 = 20, b1 = 30, d0 = 1, d1 = -1, all times 8
    assert ends(11, 100, 10, 20, 30, 1, 127)[:3].tolist() == [[720, 800], [552, 640], [488, 560]]
    # mode 5 of the scaled kind: no major, nothing relative
    assert ends(7, 0xC0 | 5, 0x80 | 3, 0x80 | 2, 1)[:3].tolist() == [[128, 160], [64, 96], [32, 64]]
    # its mode 3, red the major: the rest is less than red
    assert ends(7, 0xC0 | 40, 3, 2, 1)[:3].tolist() == [[312, 320], [288, 296], [296, 304]]
    assert ends(15, *[0] * 6, 0x80 | 4, 0x80 | 6)[3].tolist() == [128, 192]
    assert ends(15, *[0] * 6, 4, 0x3F)[3].tolist() == [64, 48]


def test_weights_and_halves():
    assert [int(astc_hdr.weight_values(0, r)[0]) for r in range(2, 8)] == [0] * 6
    for high in (0, 1):
        for r in range(2, 8):
            t = astc_hdr.weight_values(high, r)
            assert t.min() == 0 and t.max() == 64 and len(set(t.tolist())) == len(t) and set((64 - t).tolist()) == set(t.tolist())
    assert astc_hdr._unit_half(np.array([0, 32768, 65535])).tolist() == [0, half(0.5), half(1)]
    assert astc_hdr._hdr_half(np.array([0x7800, 0xFFFF])).tolist() == [0x3C00, 0x7BFF]
    spread = astc_hdr._spread(np.array([[[0], [16], [48], [64]]]), (2, 2), (4, 4))[0, :, 0]
    assert spread.reshape(4, 4).tolist() == [[0, 5, 11, 16], [15, 20, 26, 31], [33, 38, 44, 49], [48, 53, 59, 64]]


def test_shared_exponents_are_near_the_halves():
    rng = np.random.default_rng(27)
    source = astc.pack(np.frombuffer(b"".join(made(rng, k)[0] for k in (0, 2, 10, 13, 18) for _ in range(10)), np.uint8).reshape(-1, 16))
    word = astc_hdr.shared_exponents(source, (4, 4))
    got = np.stack([word >> 9 * c & 511 for c in range(3)], 2) * 2.0 ** ((word >> 27) - 24)[..., None]
    want = astc_hdr.halves(source, (4, 4)).astype(np.uint16).view(np.float16).astype(float)[..., :3]
    assert (np.abs(got - want) <= want.max(-1, keepdims=True) / 200 + 2**-20).all()
    assert int(astc_hdr.nine_e5(np.array([1.0, 0.0, 1.0]), True)) == 256 | 256 << 18 | 16 << 27
    assert (astc_hdr.shared_exponents(np.zeros((1, 16), np.uint8), (6, 6)) == 256 | 256 << 18 | 16 << 27).all()


def test_image_is_cropped():
    hdr = (0xFFFFFFFFFFFFFFFC).to_bytes(8, "little") + np.array([0x3C00, 1, 2, 3], "<u2").tobytes()
    assert astc_hdr.image(hdr * 4, 7, 8, (6, 6), "RGB_HALF") == np.array([0x3C00, 1, 2], "<u2").tobytes() * 56
    assert len(astc_hdr.image(hdr * 4, 7, 8, (4, 4), "RGBA_HALF")) == 448 and len(astc_hdr.image(hdr * 4, 7, 8, (6, 6), "RGB_9E5")) == 224
