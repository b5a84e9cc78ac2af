import struct
import zlib

import zstandard

from texelflow.codecs.zstd import decompress
from texelflow.sources import basis, ktx2

ID = bytes.fromhex(ktx2.IDENTIFIER)


def container(payloads, scheme=0, vk=37, width=2, height=2, layers=0, faces=1, full=None, dfd=b"", size_type=1):
    n = len(payloads)
    at = 80 + 24 * n
    head = ID + struct.pack("<13I2Q", vk, size_type, width, height, 0, layers, faces, n, scheme, at if dfd else 0, len(dfd), 0, 0, 0, 0)
    index, body, at = b"", dfd, at + len(dfd)
    for k, p in enumerate(payloads):
        index += struct.pack("<3Q", at, len(p), (full or [len(p)] * n)[k])
        body += p
        at += len(p)
    return head + index + body


def passed(spark, *files, image=0):
    df = spark.createDataFrame([(f"f{k}", bytearray(f)) for k, f in enumerate(files)], "path string, content binary")
    return {r["path"]: r for r in ktx2.pass_through(ktx2.descriptors(ktx2.headers(df)), image).collect()}


def test_plain_payload_and_supercompression(spark):
    raw = b"\x09\x08\x07\x06"
    got = passed(spark, container([raw]), container([zlib.compress(raw)], 3, full=[4]), container([zlib.compress(raw)[2:-4]], 3, full=[4]), container([zstandard.compress(raw)], 2, full=[4], vk=43))
    assert [bytes(got[f"f{k}"]["payload"]) for k in range(4)] == [raw] * 4  # lengths aren't held against sizes
    assert [got[f"f{k}"]["colour_space"] for k in range(4)] == ["Linear"] * 3 + ["sRGB"]
    assert got["f0"]["width"] == 2


def test_arrays_levels_and_faults(spark):
    two = container([b"abcdefgh", b"ijkl"], layers=2)
    assert bytes(passed(spark, two, image=1)["f0"]["payload"]) == b"efghkl"
    bad = [b"short", b"x" * 90, container([b"abcd"], vk=12345), container([b"abcd"], scheme=77), container([b"abcd"], width=0), container([b"abcd"], width=2**31), container([b"abcd"], size_type=2), container([b"abcd"], faces=0), container([b"abcd"])[:90], container([b"abc"], layers=2), container([b"abcd"], scheme=3, full=[4]), container([b"abcd"])[:-2]]
    got = passed(spark, *bad)
    assert all(got[f"f{k}"]["error"] and got[f"f{k}"]["payload"] is None for k in range(len(bad)))
    overlap = bytearray(container([b"abcd", b"efgh"]))
    overlap[104:112] = overlap[80:88]
    assert passed(spark, bytes(overlap))["f0"]["error"] == "levels overlap"


def test_descriptor_names_the_format(spark):
    def dfd(model, bw=4, bh=4):
        return struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", model | 1 << 8 | 2 << 16, (bw - 1) | (bh - 1) << 8) + bytes(24)

    files = [container([b"x" * 16], 1, 0, dfd=dfd(m, *s)) for m, s in ((163, (4, 4)), (166, (4, 4)), (167, (4, 4)), (168, (6, 6)), (169, (8, 5)), (99, (4, 4)))]
    df = spark.createDataFrame([(f"f{k}", bytearray(f)) for k, f in enumerate(files)], "path string, content binary")
    got = {r["path"]: r for r in ktx2.descriptors(ktx2.headers(df)).collect()}
    assert [got[f"f{k}"]["texture_format"] for k in range(6)] == ["ETC1S", "UASTC_LDR_4x4", "UASTC_HDR_4x4", "UASTC_HDR_6x6I", "XUASTC_LDR_8x5", None]
    assert got["f5"]["error"] == "unknown colour model" and got["f0"]["transfer"] == 2
    assert [r["byte_length"] for r in ktx2.levels(ktx2.headers(df)).collect()] == [16] * 6


def test_key_values():
    entry = b"K\0v1"
    data = struct.pack("<I", 4) + entry + struct.pack("<I", 3) + b"K\0w" + b"\0"
    assert ktx2.key_values(data, 0, len(data)) == [("K", b"v1"), ("K", b"w")]


def test_zstd_frames():
    assert decompress(bytes.fromhex("28B52FFD2003190000010203")) == b"\1\2\3"
    assert decompress(bytes.fromhex("28B52FFD2004230000 07".replace(" ", ""))) == b"\7" * 4
    assert decompress(bytes.fromhex("28B52FFD0000230000 07".replace(" ", ""))) == b"\7" * 4
    skip = b"\x50\x2a\x4d\x18" + struct.pack("<I", 3) + b"abc"
    assert decompress(skip + zstandard.compress(b"hello") + zstandard.compress(b"!")) == b"hello!"


def test_basis_slices(spark):
    data = bytearray(77 + 23 * 2 + 8)
    data[0:4] = b"sB" + struct.pack("<H", 0x13)
    data[14:17], data[17:20], data[23] = (2).to_bytes(3, "little"), (1).to_bytes(3, "little"), 2
    data[65:69] = struct.pack("<I", 77)
    for k in range(2):
        data[77 + 23 * k : 100 + 23 * k] = bytes([0, 0, 0, 0, k]) + struct.pack("<4H2IH", 4, 4, 1, 1, 123 + 4 * k, 4, 0)
    df = spark.createDataFrame([("a", data), ("b", bytearray(b"sBxx"))], "path string, content binary")
    heads = basis.headers(df)
    assert {r["path"]: r["error"] for r in heads.collect()} == {"a": None, "b": "too short for a header"}
    got = basis.slices(heads).orderBy("slice").collect()
    assert [(r["is_alpha"], r["byte_offset"], r["error"]) for r in got] == [(False, 123, None), (True, 127, None)]
