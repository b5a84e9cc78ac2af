import struct

import numpy as np
from test_ktx2 import container
from test_uastc import put

from texelflow.codecs import bc, bc7, packers
from texelflow.operators import blocks as B
from texelflow.operators.transcode import transcode


def test_dispatch(spark):
    solid = put([(0x17, 5), (200, 8), (2, 8), (3, 8), (90, 8)])
    dfd = lambda model: struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", model | 1 << 8 | 1 << 16, 3 | 3 << 8) + bytes(24)
    files = {"uastc": container([solid], 0, 0, 3, 2, dfd=dfd(166)), "hdr": container([solid], 0, 0, 4, 4, dfd=dfd(167)), "plain": container([b"abcd"], width=1, height=1), "bad": b"?"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {t: {r["path"]: r for r in transcode(df, t).collect()} for t in ("RGBA8", "BC5", "RGB565", "BC7")}
    assert bytes(got["RGBA8"]["uastc"]["payload"]) == bytes([200, 2, 3, 90]) * 6 and bytes(got["RGBA8"]["plain"]["payload"]) == b"abcd"
    assert bytes(got["BC5"]["uastc"]["payload"]) == bytes([200, 200]) + bytes(6) + bytes([90, 90]) + bytes(6)
    assert len(bytes(got["RGB565"]["uastc"]["payload"])) == 12
    for t in got:
        assert set(got[t]) == set(files) and got[t]["hdr"]["error"] and got[t]["bad"]["error"]
    assert got["BC5"]["plain"]["error"] and got["BC7"]["plain"]["error"]
    block = np.frombuffer(bytes(got["BC7"]["uastc"]["payload"]), np.uint8).reshape(1, 16)
    assert (bc7.texels(block) == [200, 2, 3, 90]).all()
    assert {r["error"] for r in transcode(df.filter("path = 'uastc'"), "BC6H").collect()} == {"no way to BC6H from UASTC_LDR_4x4"}


def test_packers_equal_the_expressions(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(0, 256, (40, 16)), rng.integers(0, 4, (20, 16)) + rng.integers(0, 250, (20, 1)), np.full((2, 16), 7), rng.integers(240, 256, (20, 16))])
    df = spark.createDataFrame([(k, [int(x) for x in row]) for k, row in enumerate(v)], "k int, v array<bigint>").withColumnRenamed("v", "w")
    from pyspark.sql import functions as F

    bc4 = {r["k"]: r for r in B.bc4(df, {"": F.col("w")}, ("k",)).collect()}
    eac = {r["k"]: r for r in B.eac(df, F.col("w"), ("k",)).collect()}
    for k, (one, two) in enumerate(zip(packers.bc4(v), packers.eac(v), strict=True)):
        assert bytes(one) == bytes([bc4[k]["hi"], bc4[k]["lo"]]) + bc4[k]["selectors"].to_bytes(6, "little")
        assert bytes(two) == bytes([eac[k]["base"], eac[k]["code"]]) + eac[k]["selectors"].to_bytes(6, "big")


def test_hdr_blocks_pass(spark):
    dfd = struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", 167 | 1 << 8 | 1 << 16, 3 | 3 << 8) + bytes(24)
    data = bytes(range(64))
    files = {"good": container([data, data[:16]], 0, 0, 8, 5, dfd=dfd), "short": container([data[:48]], 0, 0, 8, 5, dfd=dfd)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    rows = transcode(df, "ASTC_HDR_4X4").collect()
    assert [(r["level"], bytes(r["payload"])) for r in rows if r["path"] == "good"] == [(0, data), (1, data[:16])]
    assert [r["error"] for r in rows if r["path"] == "short"] == ["UASTC block data size mismatch"]
    assert {r["error"] for r in transcode(df, "ASTC_HDR_6X6").collect()} == {"no way to ASTC_HDR_6X6 from UASTC_HDR_4x4"}
