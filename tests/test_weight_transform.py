import numpy as np
import pytest

from texelflow.codecs import weight_transform as wt


def test_the_transform_is_orthonormal():
    rng = np.random.default_rng(1)
    for shape in ((4, 4), (5, 6), (2, 7)):
        freq = rng.normal(size=shape)
        grid = wt.inverse(freq)
        back = np.einsum("uy,yx,vx->uv", wt.basis(shape[0]), grid, wt.basis(shape[1]))
        assert np.allclose(back, freq) and np.isclose((grid**2).sum(), (freq**2).sum())


def test_order_and_steps():
    assert wt.diagonal(3, 2) == ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (2, 1))
    assert [sum(c) for c in wt.diagonal(4, 4)] == sorted(sum(c) for c in wt.diagonal(4, 4))
    assert wt.diagonal(8, 8)[:6] == ((0, 0), (1, 0), (0, 1), (0, 2), (1, 1), (2, 0))
    assert wt.step(100, 9.0, (4, 4), 3, 3) == 1 and wt.step(50, 1.0, (8, 8), 0, 0) == 4 and wt.step(50, 1.0, (8, 8), 7, 7) == 99
    assert wt.step(50, 1.0, (4, 8), 1, 0) == 10 and wt.step(50, 0.01, (8, 8), 0, 0) == 1
    assert wt.coefficient(-2, 10, 1, 0) == -20 and wt.coefficient(-2, 10, 1, 1) == -25 and wt.coefficient(1, 10, 0, 2) == 15
    assert wt.step_scale(75, 640, 5) == pytest.approx(0.5 * 0.1 * 9**0.1) and wt.step_scale(25, 1, 0) == pytest.approx(2 * 64 / 14 * 63**0.1)


def test_means_alone_and_faults():
    flat = wt.weights(wt.Plane(5, (), ()), (4, 3), (4, 4), 5, 80, 100)
    assert flat.shape == (3, 4) and (flat == 40).all()
    assert (wt.weights(wt.Plane(31, (), ()), (4, 3), (4, 4), 8, 80, 100) == 62).all()
    assert (wt.codes(flat, 2) == np.abs(np.array((0, 21, 43, 64)) - 40).argmin()).all()
    with pytest.raises(ValueError):
        wt.weights(wt.Plane(5, (11,), (1,)), (4, 3), (4, 4), 5, 80, 100)


def test_span():
    pairs = [np.array([[0, 3], [0, 4], [9, 9], [5, 5]]), np.array([[0, 6], [0, 8], [0, 0], [0, 0]])]
    assert wt.span(pairs) == 10 and wt.span(pairs[:1], 1, 1) == 4 and wt.span(pairs[:1], 1, 0) == 3
