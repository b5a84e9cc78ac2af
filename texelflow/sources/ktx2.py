"""KTX2 containers: header, levels and descriptors as expressions over binaryFile content; level payloads.

Parsing never fails a query: a row with a broken container carries its first fault in `error`. failfast() turns
that into an exception."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file identifier, and names by code.
IDENTIFIER = "AB4B5458203230BB0D0A1A0A"
SCHEMES = ("NONE", "BASISLZ", "ZSTANDARD", "DEFLATE", "UASTC_HDR_6X6I", "XUASTC_LDR")
MODELS = {163: "ETC1S", 166: "UASTC_LDR_4x4", 167: "UASTC_HDR_4x4", 168: "UASTC_HDR_6x6I"}
PLAIN = {37: "UNORM", 43: "SRGB", 50: "UNORM", 51: "SRGB"}
ASTC_SIZES = ("4x4", "5x4", "5x5", "6x5", "6x6", "8x5", "8x6", "8x8", "10x5", "10x6", "10x8", "10x10", "12x10", "12x12")
MOST_PIXELS, MOST_LEVELS, HEADER = 16384, 16, 80


def little_endian(content: Column, offset: Column | int, size: int) -> Column:
    """Unsigned number of `size` bytes, null past the end. Byte by byte: reverse() would go through a string."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    hexed = F.concat(*[F.hex(F.substring(content, (at + k + 1).cast("int"), F.lit(1))) for k in reversed(range(size))])
    number = F.conv(hexed, 16, 10)
    if size < 8:
        return F.when(F.length(hexed) == 2 * size, number.cast("bigint"))
    number = number.cast("decimal(20,0)")
    return F.when(F.length(hexed) == 2 * size, F.when(number <= 2**63 - 1, number.cast("bigint")))


def settled(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """rows with the fields. They pass a generator, so that later filters and expressions refer to their values and
    the optimizer doesn't repeat how to parse them."""
    parsed = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return rows.select(*rows.columns, parsed.alias("__parsed")).select(*rows.columns, "__parsed.*")


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of all files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


#: Names of files that are taken for containers whatever their bytes.
NAMED = ("basis", "ktx", "ktx2")


def looks_like(path: Column, content: Column) -> Column:
    """Whether a viewer takes a file for a container: by its name's ending, or by its first bytes."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    by_name = F.regexp_extract(name, r"\.(\w+)$", 1).isin(*NAMED)
    return F.coalesce(by_name, F.lit(False)) | ((F.length(content) >= 12) & kind(content).isNotNull())


def kind(content: Column) -> Column:
    """ktx2, basis or null by the first bytes."""
    return F.when(F.hex(F.substring(content, 1, 12)) == IDENTIFIER, "ktx2").when(F.hex(F.substring(content, 1, 2)) == "7342", "basis")


def headers(files: DataFrame) -> DataFrame:
    """path, content, header fields, error."""
    names = ("vk_format", "type_size", "width", "height", "depth", "layers", "faces", "levels", "scheme_code", "dfd_offset", "dfd_length", "kvd_offset", "kvd_length")
    rows = settled(files, {n: little_endian(F.col("content"), 12 + 4 * k, 4) for k, n in enumerate(names)} | {"sgd_offset": little_endian(F.col("content"), 64, 8), "sgd_length": little_endian(F.col("content"), 72, 8)})
    c = F.col
    past = lambda a, b: (c(b) > 0) & ((c(a) + c(b)) > F.length("content"))
    fault = (
        F.when(F.length("content") < HEADER, "too short for a header")
        .when(F.coalesce(kind(c("content")) != "ktx2", F.lit(True)), "not a KTX2 file")
        .when(c("type_size") != 1, "unsupported type size")
        .when((c("width") <= 0) | (c("height") <= 0) | (c("width") >= 2**31) | (c("height") >= 2**31), "invalid size")
        .when((c("width") > MOST_PIXELS) | (c("height") > MOST_PIXELS), "size above the limit")
        .when(c("layers") >= 2**31, "too many layers")
        .when(c("depth") != 0, "only two dimensions are supported")
        .when(c("faces") < 1, "invalid face count")
        .when(c("levels") <= 0, "no mip levels")
        .when(c("levels") > MOST_LEVELS, "too many mip levels")
        .when(c("sgd_offset").isNull() | c("sgd_length").isNull(), "malformed metadata offsets")
        .when(c("scheme_code") >= len(SCHEMES), "unknown supercompression")
        .when(past("dfd_offset", "dfd_length") | past("kvd_offset", "kvd_length") | past("sgd_offset", "sgd_length"), "metadata past the end")
        .when((c("dfd_length") > 0) & ~c("dfd_length").isin(44, 60), "unsupported descriptor length")
        .when(F.length("content") < HEADER + 24 * c("levels"), "truncated level index")
    )
    scheme = F.get(F.array(*[F.lit(s) for s in SCHEMES]), F.when(c("scheme_code") < len(SCHEMES), c("scheme_code").cast("int")))
    images = F.greatest(c("layers"), F.lit(1)) * c("faces")
    return settled(rows, {"scheme": scheme, "images": images, "error": fault})


def descriptors(rows: DataFrame) -> DataFrame:
    """headers() with model, primaries, transfer, block sizes and the texture format they name."""
    at = F.col("dfd_offset")
    word, size = little_endian(F.col("content"), at + 12, 4), little_endian(F.col("content"), at + 16, 4)
    there = (F.col("dfd_length") > 0) & F.col("error").isNull()
    field = lambda w, shift, n: F.when(there, F.shiftright(w, shift).bitwiseAND(n))
    rows = settled(rows, {"model": field(word, 0, 255), "primaries": field(word, 8, 255), "transfer": field(word, 16, 255), "block_width": field(size, 0, 255) + 1, "block_height": field(size, 8, 255) + 1})
    size_name = F.concat_ws("x", F.col("block_width").cast("string"), F.col("block_height").cast("string"))
    out = F.lit(None).cast("string")
    for code, name in MODELS.items():
        out = F.when(F.col("model") == code, name).otherwise(out)
    out = F.when(F.col("model") == 169, F.concat(F.lit("XUASTC_LDR_"), size_name)).otherwise(out)
    out = F.when((F.col("model") == 162) & (F.col("vk_format") == 1000066004) & (size_name == "6x6"), "ASTC_HDR_6x6").otherwise(out)
    out = F.when((F.col("model") == 162) & F.col("vk_format").between(157, 184), F.concat(F.lit("ASTC_LDR_"), size_name)).otherwise(out)
    rows = settled(rows, {"texture_format": out})
    fault = F.when((F.col("dfd_length") > 0) & F.col("texture_format").isNull(), "unknown colour model")
    return settled(rows.withColumnRenamed("error", "__fault"), {"error": F.coalesce("__fault", fault)}).drop("__fault")


def levels(rows: DataFrame) -> DataFrame:
    """path, level, byte_offset, byte_length, uncompressed_length, error of each level of sound headers."""
    sound = rows.filter("error is null").select("path", "content", F.explode(F.sequence(F.lit(0), (F.col("levels") - 1).cast("int"))).alias("level"))
    at = F.col("level") * 24 + HEADER
    names = ("byte_offset", "byte_length", "uncompressed_length")
    out = sound.withColumns({n: little_endian(F.col("content"), at + 8 * k, 8) for k, n in enumerate(names)})
    fault = F.when(F.col("byte_offset").isNull() | F.col("byte_length").isNull() | F.col("uncompressed_length").isNull(), "malformed level").when(F.col("byte_offset") + F.col("byte_length") > F.length("content"), "level past the end")
    return out.select("path", "level", *names, fault.alias("error"))


def key_values(content: bytes, offset: int, length: int) -> list[tuple[str, bytes]]:
    """All entries in order, duplicates too."""
    out, at, end = [], offset, offset + length
    while at + 4 <= end:
        n = int.from_bytes(content[at : at + 4], "little")
        entry = content[at + 4 : at + 4 + n]
        key, sep, value = entry.partition(b"\0")
        if at + 4 + n > end or not sep:
            raise ValueError("malformed key/value data")
        out.append((key.decode(), value))
        at += 4 + n + (-n % 4)
    return out


def described(content: bytes) -> dict:
    """What descriptors() says of one file, read in Python: for callers outside a DataFrame."""
    if content[:12].hex().upper() != IDENTIFIER or len(content) < HEADER:
        raise ValueError("not a KTX2 file" if len(content) >= HEADER else "too short for a header")
    w = struct.unpack_from("<13I2Q", content, 12)
    names = ("vk_format", "type_size", "width", "height", "depth", "layers", "faces", "levels", "scheme_code", "dfd_offset", "dfd_length", "kvd_offset", "kvd_length", "sgd_offset", "sgd_length")
    r: dict = dict(zip(names, w, strict=True))
    past = any(r[f"{n}_length"] and r[f"{n}_offset"] + r[f"{n}_length"] > len(content) for n in ("dfd", "kvd", "sgd"))
    for wrong, fault in (
        (r["type_size"] != 1, "unsupported type size"),
        (not 0 < r["width"] < 2**31 or not 0 < r["height"] < 2**31, "invalid size"),
        (max(r["width"], r["height"]) > MOST_PIXELS, "size above the limit"),
        (r["depth"] != 0, "only two dimensions are supported"),
        (r["faces"] < 1, "invalid face count"),
        (not 0 < r["levels"] <= MOST_LEVELS, "no mip levels" if not r["levels"] else "too many mip levels"),
        (r["scheme_code"] >= len(SCHEMES), "unknown supercompression"),
        (past, "metadata past the end"),
        (r["dfd_length"] not in (0, 44, 60), "unsupported descriptor length"),
        (len(content) < HEADER + 24 * r["levels"], "truncated level index"),
    ):
        if wrong:
            raise ValueError(fault)
    r |= {"scheme": SCHEMES[r["scheme_code"]], "images": max(r["layers"], 1) * r["faces"], "texture_format": None, "error": None}
    if r["dfd_length"]:
        word, size = struct.unpack_from("<2I", content, r["dfd_offset"] + 12)
        block = f"{(size & 255) + 1}x{(size >> 8 & 255) + 1}"
        model = word & 255
        r["texture_format"] = MODELS.get(model) or {169: f"XUASTC_LDR_{block}"}.get(model)
        if model == 162:
            hdr, ldr = r["vk_format"] == 1000066004 and block == "6x6", 157 <= r["vk_format"] <= 184
            r["texture_format"] = "ASTC_HDR_6x6" if hdr else f"ASTC_LDR_{block}" if ldr else None
        if r["texture_format"] is None:
            raise ValueError("unknown colour model")
    return r


def key_value_rows(rows: DataFrame) -> DataFrame:
    """path, place, key, value, error of each entry of headers() rows; malformed data are one row with the fault."""
    wanted = rows.filter("error is null").select("path", "content", "kvd_offset", "kvd_length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(path, k, key, value, None) for k, (key, value) in enumerate(key_values(content, at, n))]
                except ValueError as e:
                    out.append((path, None, None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["path", "place", "key", "value", "error"])

    return wanted.mapInArrow(run, "path string, place int, key string, value binary, error string")


def inflate(data: bytes, expected: int) -> bytes:
    """Deflate with a zlib wrapper, else raw; never more than `expected` bytes."""
    for mode in (15, -15):
        d = zlib.decompressobj(mode)
        try:
            out = d.decompress(data, expected + 1)
        except zlib.error:
            continue
        if len(out) == expected and d.eof or len(out) == expected == 0:
            return out
    raise ValueError("deflate size mismatch")


def unpacked(scheme: str, data: bytes, expected: int) -> bytes:
    if scheme == "NONE":
        return data
    if scheme == "DEFLATE":
        return inflate(data, expected)
    if scheme == "ZSTANDARD":
        from ..codecs.zstd import decompress

        out = decompress(data)
        if len(out) != expected:
            raise ValueError("zstd size mismatch")
        return out
    raise ValueError(f"unsupported level supercompression {scheme}")


def level_ranges(content: bytes, levels: int) -> list[tuple[int, int, int]]:
    """(offset, length, uncompressed length) of each level; levels past the end or over each other are a ValueError."""
    found = [tuple(int.from_bytes(content[HEADER + 24 * k + 8 * j :][:8], "little") for j in range(3)) for k in range(levels)]
    if any(at + n > len(content) for at, n, _ in found):
        raise ValueError("level past the end")
    ranges = sorted((at, at + n) for at, n, _ in found if n)
    if any(a[1] > b[0] for a, b in zip(ranges, ranges[1:], strict=False)):
        raise ValueError("levels overlap")
    return found


#: Bytes of a slice's row in the global data of containers without palettes: offset, length and, in the longer one, profile.
SLICE_ROWS = (12, 8)


def slice_ranges(content: bytes, r: dict) -> list[tuple[int, int, int]]:
    """(offset, length, profile) of each image and level of a descriptors() row whose global data are slice ranges."""
    at, n, count = r["sgd_offset"], r["sgd_length"], r["images"] * r["levels"]
    if not n:
        if at:
            raise ValueError("offset of empty global data")
        return []
    if at < HEADER or at + n > len(content):
        raise ValueError("global data past the end")
    size = next((s for s in SLICE_ROWS if s * count == n), None)
    if size is None:
        raise ValueError("global data don't match the number of images")
    out = []
    for k in range(at, at + n, size):
        words = [int.from_bytes(content[p : p + 4], "little") for p in range(k, k + size, 4)]
        if not words[1]:
            raise ValueError("empty slice")
        out.append((words[0], words[1], words[2] if size == 12 else 0))
    return out


def block_images(content: bytes, r: dict, block: tuple[int, int]) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, blocks) of a descriptors() row whose levels hold 16-byte blocks of this size."""
    for level, (at, n, full) in enumerate(level_ranges(content, r["levels"])):
        data = unpacked(r["scheme"], content[at : at + n], full)
        w, h = max(1, r["width"] >> level), max(1, r["height"] >> level)
        size = -(-w // block[0]) * -(-h // block[1]) * 16
        if len(data) != size * r["images"]:
            raise ValueError(f"{r['texture_format'].partition('_')[0]} block data size mismatch")
        for k in range(r["images"]):
            yield k, level, w, h, data[k * size : (k + 1) * size]


def plain(r: dict, image: int) -> tuple:
    """(colour space, level sizes, payload, error) of a descriptors() row."""
    if r["error"]:
        return (None, None, None, r["error"])
    if r["texture_format"] or r["vk_format"] not in PLAIN:
        return (None, None, None, "not a plain RGBA payload")
    if not 0 <= image < r["images"]:
        return (None, None, None, "image index out of range")
    parts = []
    try:
        for at, n, full in level_ranges(bytes(r["content"]), r["levels"]):
            data = unpacked(r["scheme"], r["content"][at : at + n], full)
            if len(data) % r["images"]:
                raise ValueError("level cannot be divided into images")
            size = len(data) // r["images"]
            parts.append(data[image * size : (image + 1) * size])
    except Exception as e:  # any fault of a container's bytes belongs to its row
        return (None, None, None, str(e))
    return ("sRGB" if PLAIN[r["vk_format"]] == "SRGB" else "Linear", [len(p) for p in parts], b"".join(parts), None)


def pass_through(rows: DataFrame, image: int = 0) -> DataFrame:
    """path, width, height, colour_space, level sizes, payload (all levels in order), error of plain RGBA files.

    rows: descriptors(). As the format's readers do, a payload's length isn't held against the size, and BGRA bytes
    aren't swizzled."""
    wanted = rows.select("path", "content", "vk_format", "scheme", "images", "width", "height", "levels", "texture_format", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [plain(r, image) for r in batch.to_pylist()]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("width"), batch.column("height"), *cols], ["path", "width", "height", "colour_space", "sizes", "payload", "error"])

    return wanted.mapInArrow(run, "path string, width bigint, height bigint, colour_space string, sizes array<bigint>, payload binary, error string")


def failfast(rows: DataFrame) -> DataFrame:
    """rows without `error`; the first fault ends the query."""
    return rows.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean"))).drop("error")
