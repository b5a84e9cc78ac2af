"""`.basis` containers: header and slice descriptors as expressions over the content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import astc, etc1s, hdr6x6i, uastc
from .ktx2 import kind, little_endian, settled

#: name, offset, bytes
HEADER_FIELDS = (("version", 2, 2), ("header_size", 4, 2), ("data_size", 8, 4), ("slices", 14, 3), ("images", 17, 3), ("format_code", 20, 1), ("flags", 21, 2), ("type_code", 23, 1), ("us_per_frame", 24, 3), ("endpoints", 39, 2), ("endpoint_offset", 41, 4), ("endpoint_size", 45, 3), ("selectors", 48, 2), ("selector_offset", 50, 4), ("selector_size", 54, 3), ("tables_offset", 57, 4), ("tables_size", 61, 4), ("slice_offset", 65, 4), ("extended_offset", 69, 4), ("extended_size", 73, 4))
SLICE_FIELDS = (("image", 0, 3), ("level", 3, 1), ("flags", 4, 1), ("width", 5, 2), ("height", 7, 2), ("blocks_x", 9, 2), ("blocks_y", 11, 2), ("byte_offset", 13, 4), ("byte_length", 17, 4), ("crc", 21, 2))
HEADER, SLICE = 77, 23
#: By code; payloads of others have no decoder here.
FORMATS = ("ETC1S", "UASTC_LDR_4x4", "UASTC_HDR_4x4", "ASTC_HDR_6x6", "UASTC_HDR_6x6I")
TEXTURE_TYPES = ("2D", "2D_ARRAY", "CUBEMAP", "VIDEO", "VOLUME")


def headers(files: DataFrame) -> DataFrame:
    """path, content, header fields, error. Fields are little-endian after the two bytes `sB`."""
    rows = settled(files, {n: little_endian(F.col("content"), at, size) for n, at, size in HEADER_FIELDS})
    fault = (
        F.when(F.length("content") < HEADER, "too short for a header")
        .when(F.coalesce(kind(F.col("content")) != "basis", F.lit(True)), "not a .basis file")
        .when(F.col("version") < 0x10, "version too old")
        .when((F.col("slices") == 0) | (F.col("images") == 0), "no slices or images")
        .when(F.col("slice_offset") + F.col("slices") * SLICE > F.length("content"), "slice table past the end")
    )
    return rows.withColumns({"texture_type": F.get(F.array(*[F.lit(t) for t in TEXTURE_TYPES]), F.col("type_code").cast("int")), "error": fault})


def slices(rows: DataFrame) -> DataFrame:
    """path, slice, descriptor fields, is_alpha, is_iframe, error of each slice of sound headers."""
    each = rows.filter("error is null").select("path", "content", "slice_offset", "images", F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice"))
    at = F.col("slice_offset") + F.col("slice") * SLICE
    out = settled(each, {n: little_endian(F.col("content"), at + k, size) for n, k, size in SLICE_FIELDS})
    fault = F.when(F.col("image") >= F.col("images"), "image index out of range").when(F.col("byte_offset") + F.col("byte_length") > F.length("content"), "slice past the end")
    return out.select("path", "slice", *[n for n, _, _ in SLICE_FIELDS], (F.col("flags").bitwiseAND(1) != 0).alias("is_alpha"), (F.col("flags").bitwiseAND(2) != 0).alias("is_iframe"), fault.alias("error"))


def texture_format(content: bytes) -> str | None:
    code = content[20] if len(content) >= HEADER else len(FORMATS)
    return FORMATS[code] if code < len(FORMATS) else None


def _levels(described: list[dict], image: int, alpha: bool | None) -> list[dict]:
    """An image's slices by level; alpha None: of any kind."""
    own = sorted((d for d in described if d["image"] == image and (alpha is None or bool(d["flags"] & 1) == alpha)), key=lambda d: d["level"])
    have = [d["level"] for d in own]
    if len(set(have)) < len(have):
        raise ValueError(f"image {image} has duplicate mip levels")
    if not own or have != list(range(len(own))):
        raise ValueError(f"image {image} has missing mip levels")
    return own


def images(content: bytes, target: str, image: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of each image, or of one, in the target format; a fault is a ValueError.

    A video's frames are folded once, in order; each may copy blocks of the one before, the first those of index 0."""
    word = lambda at, n: int.from_bytes(content[at : at + n], "little")
    if len(content) < HEADER or content[:2] != b"sB":
        raise ValueError("not a .basis file")
    head = {n: word(at, size) for n, at, size in HEADER_FIELDS}
    if head["version"] < 0x10:
        raise ValueError("version too old")
    if not head["slices"] or not head["images"]:
        raise ValueError("no slices or images")
    if head["slice_offset"] + head["slices"] * SLICE > len(content):
        raise ValueError("slice table past the end")
    described = [{n: word(head["slice_offset"] + SLICE * k + at, size) for n, at, size in SLICE_FIELDS} for k in range(head["slices"])]
    by_image: dict[int, list[dict]] = {}
    for d in described:
        if d["image"] >= head["images"]:
            raise ValueError("image index out of range")
        if d["byte_offset"] + d["byte_length"] > len(content):
            raise ValueError("slice past the end")
        by_image.setdefault(d["image"], []).append(d)
    if image is not None and not 0 <= image < head["images"]:
        raise ValueError("image index out of range")
    data = lambda d: content[d["byte_offset"] :][: d["byte_length"]]
    video = head["type_code"] == TEXTURE_TYPES.index("VIDEO")
    wanted = range(head["images"]) if image is None else range(0 if video else image, image + 1)
    coded = texture_format(content)
    if coded != "ETC1S":
        for k in wanted if image is None else [image]:
            for d in _levels(by_image.get(k, []), k, None):
                size = (d["width"], d["height"])
                if coded == "UASTC_LDR_4x4":
                    yield k, d["level"], *size, uastc.image(data(d), *size, target)
                elif coded == "UASTC_HDR_6x6I":
                    yield k, d["level"], *size, hdr6x6i.image(data(d), *size, target)
                else:
                    yield k, d["level"], *size, astc.hdr_image(data(d), *size, coded, target)
        return
    part = lambda name, size: content[head[name] :][: head[size]]
    book = etc1s.codebook(part("endpoint_offset", "endpoint_size"), head["endpoints"], part("selector_offset", "selector_size"), head["selectors"], part("tables_offset", "tables_size"))
    with_alpha = any(d["flags"] & 1 for d in described)
    before: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}

    def read(d: dict, alpha: bool) -> tuple[np.ndarray, np.ndarray]:
        nx, ny = -(-d["width"] // 4), -(-d["height"] // 4)
        key, last = (d["level"], alpha), None
        if video:
            last = before.get(key)
            if last is None or last[0].shape != (ny, nx):
                last = (np.zeros((ny, nx), np.int64), np.zeros((ny, nx), np.int64))
        before[key] = got = etc1s.blocks(data(d), book, nx, ny, last)
        return got

    count = None
    for k in wanted:
        levels = _levels(by_image.get(k, []), k, False)
        if video and count not in (None, len(levels)):
            raise ValueError("a frame has another count of mip levels")
        count = len(levels)
        alphas = _levels(by_image.get(k, []), k, True) if with_alpha else [None] * count
        if len(alphas) != count or with_alpha and any((a["width"], a["height"]) != (d["width"], d["height"]) for a, d in zip(alphas, levels, strict=True)):
            raise ValueError(f"alpha slices of image {k} do not match")
        for d, a in zip(levels, alphas, strict=True):
            colour, opacity = read(d, False), read(a, True) if a else None
            if image in (None, k):
                yield k, d["level"], d["width"], d["height"], etc1s.finished(colour, opacity, book, d["width"], d["height"], target)
