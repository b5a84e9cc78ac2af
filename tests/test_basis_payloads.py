import struct

import numpy as np
import pytest
from test_etc1s import Writer, book_bytes, stream
from test_uastc import put

from texelflow.codecs import etc1, etc1s, packers, uastc
from texelflow.operators.transcode import transcode
from texelflow.sources import basis


def file(slices, code, kind=0, book=None):
    """slices: (image, level, flags, width, height, data)."""
    images = 1 + max(s[0] for s in slices)
    at = basis.HEADER + basis.SLICE * len(slices)
    parts = list(book[:3]) if book else [b""] * 3
    offsets = []
    for p in [*parts, *(s[5] for s in slices)]:
        offsets.append(at)
        at += len(p)
    head = bytearray(basis.HEADER)
    head[0:4] = b"sB" + struct.pack("<H", 0x13)
    values = {"slices": len(slices), "images": images, "format_code": code, "type_code": kind, "slice_offset": basis.HEADER}
    if book:
        values |= {"endpoints": book[3], "selectors": book[4], "endpoint_offset": offsets[0], "endpoint_size": len(parts[0]), "selector_offset": offsets[1], "selector_size": len(parts[1]), "tables_offset": offsets[2], "tables_size": len(parts[2])}
    for name, place, size in basis.HEADER_FIELDS:
        if name in values:
            head[place : place + size] = values[name].to_bytes(size, "little")
    table = b"".join(i.to_bytes(3, "little") + bytes([lv, fl]) + struct.pack("<4H2IH", w, h, -(-w // 4), -(-h // 4), o, len(d), 0) for (i, lv, fl, w, h, d), o in zip(slices, offsets[3:], strict=True))
    return bytes(head) + table + b"".join([*parts, *(s[5] for s in slices)])


@pytest.fixture
def made():
    rng = np.random.default_rng(4)
    ends = [tuple(int(x) for x in (*rng.integers(0, 32, 3), rng.integers(0, 8))) for _ in range(9)]
    sels = rng.integers(0, 4, (7, 16))
    a, b, t, codes = book_bytes(ends, sels)
    return rng, (a, b, t, 9, 7), codes, etc1s.codebook(a, 9, b, 7, t)


def test_alpha_levels_and_faults(spark, made):
    rng, parts, codes, book = made
    grids = [(rng.integers(0, 9, s), rng.integers(0, 7, s)) for s in ((4, 5), (2, 3))]
    data = [stream(*g, 9, 7, 4, codes) for g in grids]
    other = (rng.integers(0, 9, (4, 5)), rng.integers(0, 7, (4, 5)))
    slices = [(0, 0, 0, 18, 15, data[0]), (0, 0, 1, 18, 15, stream(*other, 9, 7, 4, codes)), (0, 1, 0, 9, 7, data[1]), (0, 1, 1, 9, 7, data[1])]
    good = file(slices, 0, book=parts)
    files = {"good": good, "missing": file([slices[2]], 0, book=parts), "twice": file([slices[0], slices[0]], 0, book=parts), "uneven": file([*slices[:3], (0, 1, 1, 8, 7, data[1])], 0, book=parts), "cut": good[: len(good) - 9], "hdr": file([slices[0]], 2), "short": b"sB"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "path string, content binary")
    rows = transcode(df, "RGBA8").collect()
    got = {r["level"]: r for r in rows if r["path"] == "good"}
    want = etc1s.colours(*grids[0], book, 18, 15)
    want[..., 3] = etc1s.colours(*other, book, 18, 15)[..., 0]
    assert bytes(got[0]["payload"]) == want.tobytes() and (got[1]["width"], got[1]["height"]) == (9, 7)
    assert {r["path"] for r in rows if r["error"]} == {*files, "null"} - {"good"}
    # blocks: colours as they are, alpha packed, whole blocks at the edge
    blocks = np.frombuffer(bytes(next(r for r in transcode(df.filter("path = 'good'"), "ETC2").collect() if r["level"] == 0)["payload"]), np.uint8).reshape(20, 16)
    full = etc1s.colours(*grids[0], book, 20, 16)
    assert (etc1.texels(blocks[:, 8:]) == np.stack([packers.blocks(full[..., c]) for c in range(3)], axis=2)).all()
    assert (blocks[:, :8] == packers.eac(packers.blocks(etc1s.colours(*other, book, 20, 16)[..., 0]))).all()


def test_video(spark, made):
    rng, parts, codes, book = made
    e, s = rng.integers(0, 9, (2, 2)), rng.integers(0, 7, (2, 2))
    same = Writer()
    codes[0](same, 0b10101010)  # every block as in the frame before
    part = Writer()
    codes[0](part, 0b10101011)  # but the first
    codes[1](part, 4)
    codes[2](part, 3)
    frames = [stream(e, s, 9, 7, 4, codes, runs=False), same.done(), part.done()]
    video = file([(k, 0, 0, 8, 8, d) for k, d in enumerate(frames)], 0, 3, parts)
    df = spark.createDataFrame([("v", bytearray(video))], "path string, content binary")
    got = [bytes(r["payload"]) for r in transcode(df, "RGBA8").orderBy("image").collect()]
    e2, s2 = e.copy(), s.copy()
    e2[0, 0], s2[0, 0] = 4, 3
    first = etc1s.colours(e, s, book, 8, 8).tobytes()
    assert got == [first, first, etc1s.colours(e2, s2, book, 8, 8).tobytes()]
    assert [bytes(r["payload"]) for r in transcode(df, "RGBA8", 2).collect()] == got[2:]
    still = file([(0, 0, 0, 8, 8, frames[1])], 0, 0, parts)  # not a video: nothing to copy from
    assert transcode(spark.createDataFrame([("s", bytearray(still))], "path string, content binary"), "RGBA8").first()["error"]


def test_uastc_levels_of_any_flags(spark):
    solid = put([(0x17, 5), (9, 8), (8, 8), (7, 8), (6, 8)])
    made = {}
    for flags in ("000", "011", "100", "111"):
        made[flags] = file([(0, k, int(f), 8 >> k, 8 >> k, solid * (4 if k == 0 else 1)) for k, f in enumerate(flags)], 1)
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    rows = transcode(df, "RGBA8").collect()
    assert {(r["path"], len(r["payload"])) for r in rows} == {(f, n) for f in made for n in (256, 64, 16)}
    assert {bytes(r["payload"])[:4] for r in rows} == {bytes([9, 8, 7, 6])}
    for target, size in (("BC7", 16), ("BC1", 8), ("ASTC_LDR_4X4", 16)):
        assert sorted(len(r["payload"]) for r in transcode(df.filter("path = '000'"), target).collect()) == [size, size, 4 * size]
    assert (uastc.texels(np.frombuffer(solid, np.uint8).reshape(1, 16)) == [9, 8, 7, 6]).all()
