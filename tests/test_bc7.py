import numpy as np
import pytest

from texelflow.codecs import bc, bc7


def one_by_one(block, mode):
    """Texels of a block, field by field."""
    value, at = int.from_bytes(block, "little"), mode + 1
    m = bc7.MODES[mode]

    def take(n):
        nonlocal at
        at += n
        return value >> (at - n) & ((1 << n) - 1)

    pattern, rotation, choice = (take(n) for n in (m.pattern, m.rotation, m.choice))
    group = [0] * 16 if m.groups == 1 else [int(c) for c in (bc7.GROUPS_2 if m.groups == 2 else bc7.GROUPS_3)[pattern]]
    anchors = {1: {0}, 2: {0, bc7.ANCHOR_2[pattern]}, 3: {0, bc7.ANCHOR_3_SECOND[pattern], bc7.ANCHOR_3_THIRD[pattern]}}[m.groups]
    ends = {}
    for c, n in enumerate([m.colour] * 3 + [m.alpha] * (m.alpha > 0)):
        for g in range(m.groups):
            for k in (0, 1):
                ends[g, k, c] = take(n), n
    if m.lowest:
        low = [take(1) for _ in range(m.groups * m.lowest)]
        for (g, k, c), (v, n) in ends.items():
            ends[g, k, c] = v << 1 | low[g * m.lowest + (k if m.lowest == 2 else 0)], n + 1
    full = {key: (v << (8 - n)) | (v >> (2 * n - 8)) for key, (v, n) in ends.items()}
    first = [take(m.index - (t in anchors)) for t in range(16)]
    other = [take(m.second - (t in anchors)) for t in range(16)] if m.second else first
    assert at == 128
    out = np.full((16, 4), 255)
    for t in range(16):
        wc, wa = bc7.WEIGHTS[m.index][first[t]], bc7.WEIGHTS[m.second or m.index][other[t]]
        if choice:
            wc, wa = wa, wc
        for c in range(4 if m.alpha else 3):
            w = wa if c == 3 else wc
            out[t, c] = (full[group[t], 0, c] * (64 - w) + full[group[t], 1, c] * w + 32) >> 6
        if rotation:
            out[t, rotation - 1], out[t, 3] = out[t, 3], out[t, rotation - 1]
    return out


@pytest.mark.parametrize("mode", range(8))
def test_all_modes(mode):
    rng = np.random.default_rng(mode)
    blocks = rng.integers(0, 256, (150, 16), dtype=np.uint8)
    blocks[:, 0] = blocks[:, 0] & (256 - (2 << mode)) & 255 | 1 << mode
    got = bc7.texels(blocks)
    for b, t in zip(blocks, got, strict=True):
        assert (one_by_one(b.tobytes(), mode) == t).all()


def test_tables():
    assert len(bc7.GROUPS_2) == len(bc7.GROUPS_3) == 64 and all(len(g) == 16 for g in (*bc7.GROUPS_2, *bc7.GROUPS_3))
    for p in range(64):  # an anchor lies in its group, and texel 0 in the first
        assert bc7.GROUPS_2[p][0] == bc7.GROUPS_3[p][0] == "0" and bc7.GROUPS_2[p][bc7.ANCHOR_2[p]] == "1"
        assert (bc7.GROUPS_3[p][bc7.ANCHOR_3_SECOND[p]], bc7.GROUPS_3[p][bc7.ANCHOR_3_THIRD[p]]) == ("1", "2")
    with pytest.raises(ValueError):
        bc7.texels(np.zeros((1, 16), np.uint8))


def test_two_groups_fit_what_one_axis_cannot():
    rng = np.random.default_rng(5)
    patterns = rng.integers(0, 64, 200)
    colours = rng.integers(0, 256, (200, 2, 3))
    t = np.full((200, 16, 4), 255, np.uint8)
    for k, p in enumerate(patterns):
        group, _ = bc7.layout(2, int(p))
        shade = rng.integers(0, 40, (16, 1)) - 20
        t[k, :, :3] = np.clip(colours[k][group] + shade, 0, 255)
    blocks = bc.pack_bc7(t)
    two = (blocks[:, 0] & 3) == 2
    error = ((bc7.texels(blocks).astype(int) - t) ** 2).sum((1, 2))
    assert two.mean() > 0.7 and np.sqrt(error.mean() / 64) < 4
    # the pattern is among those tried, and the error told is the block's own
    told, made = bc7.two_groups(t[..., :3])
    off = ((bc7.texels(made).astype(int) - t) ** 2).sum((1, 2))
    assert (np.abs(told - off) < 1).all()
    see_through = t.copy()
    see_through[:, 0, 3] = 9
    assert ((bc.pack_bc7(see_through)[:, 0] & 127) == 64).all()
