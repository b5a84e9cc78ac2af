import numpy as np
import pytest

from texelflow.codecs import bc6h


def test_round_trips():
    rng = np.random.default_rng(3)
    lo, hi = rng.integers(0, 0x7BFF, (2, 400, 1, 3))
    share = rng.random((400, 16, 1))
    smooth = (lo * share + hi * (1 - share)).astype(np.int64)
    got = bc6h.texels(bc6h.pack(smooth))
    span = np.abs(hi - lo).max((1, 2))
    assert (np.abs(got - smooth).max((1, 2)) <= span / 16 + 40).all()
    flat = np.repeat(rng.integers(0, 0x7BFF, (50, 1, 3)), 16, axis=1)
    assert (np.abs(bc6h.texels(bc6h.pack(flat)) - flat) <= 32).all()
    ends = np.array([0, 0x7BFF])[rng.integers(0, 2, (20, 16, 1)) + np.zeros((1, 1, 3), int)]
    assert (bc6h.texels(bc6h.pack(ends)) == ends).all()  # black and the greatest value are exact


def test_what_the_format_cannot_hold():
    odd = np.array([0x8000, 0xBC00, 0x7C00, 0x7E01, 0xFC00, 0x3C00])
    assert bc6h.sound(odd).tolist() == [0, 0, 0x7BFF, 0, 0, 0x3C00]
    with pytest.raises(ValueError):
        bc6h.texels(np.zeros((1, 16), np.uint8))


def test_images_of_any_size():
    assert len(bc6h.image(np.zeros((5, 7, 3), np.uint16))) == 4 * 16
