"""Packed blocks, read again: exact where a format can be, near elsewhere, and near the best pair of 16-bit colours."""

import itertools

import numpy as np

from texelflow.codecs import bc, bc7, etc1, packers


def smooth(n=200, seed=3):
    """Blocks whose colours lie about a line, solid ones and noise."""
    rng = np.random.default_rng(seed)
    a, b, t = rng.integers(0, 256, (n, 1, 4)), rng.integers(0, 256, (n, 1, 4)), rng.random((n, 16, 1))
    line = np.clip(a + (b - a) * t + rng.normal(0, 2, (n, 16, 4)), 0, 255).astype(np.int64)
    return line, np.repeat(rng.integers(0, 256, (n, 1, 4)), 16, axis=1), rng.integers(0, 256, (n, 16, 4))


def rmse(a, b):
    return float(np.sqrt(((a.astype(float) - b) ** 2).mean()))


def test_bc1_and_bc3():
    line, solid, noise = smooth()
    assert rmse(bc.bc1_texels(bc.bc1(line[..., :3])), line[..., :3]) < 15 and rmse(bc.bc1_texels(bc.bc1(solid[..., :3])), solid[..., :3]) < 3
    word = bc.bc1(noise[..., :3]).view("<u2")
    assert (word[:, 0] >= word[:, 1]).all()
    whole = packers._block_bytes(line, "BC3")
    assert (whole[:, :8] == packers.bc4(line[..., 3])).all() and (bc.bc1_texels(whole[:, 8:], True) == bc.bc1_texels(bc.bc1(line[..., :3]))).all()
    # two colours that 16 bits hold exactly stay exact
    two = np.where(np.arange(16)[None, :, None] % 3 == 0, np.array([255, 0, 0]), np.array([0, 0, 255]))
    assert (bc.bc1_texels(bc.bc1(two)) == two).all()


def test_bc7():
    line, solid, noise = smooth()
    assert (bc7.texels(bc.pack_bc7(solid)) == solid).all()
    assert rmse(bc7.texels(bc.pack_bc7(line)), line) < 4 and rmse(bc7.texels(bc.pack_bc7(noise)), noise) < 75
    assert (bc.solid_ends() >= 0).all()


def test_etc1():
    line, solid, _ = smooth()
    grey = np.repeat(line[..., :1], 3, axis=2)
    assert rmse(etc1.texels(etc1.pack(grey)), grey) < 12 and rmse(etc1.texels(etc1.pack(solid[..., :3])), solid[..., :3]) < 6
    halves = np.where(np.arange(16)[None, :, None] // 8 == 0, np.array([0, 255, 17]), np.array([255, 0, 238]))
    assert rmse(etc1.texels(etc1.pack(halves)), halves) < 4  # one split fits, the other doesn't


def test_rare_texels_stay_within_the_steps():
    """Greys whose least squares would give up one texel for the others."""
    one = [140, 97, 120, 157, 89, 100, 63, 155, 100, 121, 97, 153, 86, 157, 247, 132]
    grey = np.array([one, [5] * 4 + [127] * 11 + [250], [0] * 4 + [162] * 11 + [255], [250] * 8 + [160] * 7 + [5]])
    v = np.repeat(grey[:, :, None], 4, axis=2).astype(np.uint8)
    span, off = np.ptp(grey, axis=1), lambda t: np.abs(t[..., :3].astype(int) - grey[:, :, None]).max((1, 2))
    assert (off(bc.bc1_texels(bc.bc1(v[..., :3]))) <= span / 6 + 10).all()
    assert (off(bc7.texels(bc.pack_bc7(v))) <= span / 30 + 3).all()


def test_palette_blocks_lose_nothing():
    rng = np.random.default_rng(5)
    ends = np.array([(*rng.integers(0, 32, 3), t) for t in itertools.islice(itertools.cycle(range(8)), 64)])
    selectors = rng.integers(0, 4, (64, 16))
    base = ends[:, :3] << 3 | ends[:, :3] >> 2
    want = np.clip(base[:, None] + etc1.MODIFIERS[ends[:, 3][:, None], selectors][..., None], 0, 255)
    assert (etc1.texels(etc1.of_palette(ends, selectors)) == want).all()


def test_images_of_odd_sizes():
    rgba = np.random.default_rng(1).integers(0, 256, (9, 6, 4)).astype(np.uint8)
    for target, size in (("BC1", 8), ("BC3", 16), ("BC7", 16), ("ETC1", 8), ("ETC2", 16), ("ETC2_NO_ALPHA", 8), ("BC5", 16)):
        assert len(packers.pack(rgba, target)) == 3 * 2 * size
