"""Containers to images of a target format: one pass over the files, dispatch by format, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import astc, astc_hdr, etc1s, hdr6x6i, packers, uastc
from ..plans import catalog
from ..sources import basis, ktx2

OUT = "path string, image int, level int, width int, height int, target string, payload binary, error string"
NAMES = ("path", "image", "level", "width", "height", "target", "payload", "error")
KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
#: What a reader of malformed streams may raise.
FAULTS = (ValueError, IndexError, StopIteration, RuntimeError, ZeroDivisionError, OverflowError)
#: Bytes and rows of files, and of results, that are held at a time; a larger file or image is held alone.
HELD, ROWS = 1 << 20, 1024
#: Bytes of a file of UASTC blocks up to which it is decoded with others.
SMALL = 16 * packers.CHUNK


#: Targets that have a way from each source.
MADE = {"ETC1S": packers.PACKED, "UASTC_LDR_4x4": (*packers.PACKED, "ASTC_LDR_4X4")} | {name: (target, "BC6H", *astc_hdr.TARGETS) for name, (_, target) in astc.HDR.items()}
MADE["UASTC_HDR_6x6I"] = MADE["ASTC_HDR_6x6"]
READERS = {"UASTC_HDR_6x6I": hdr6x6i.images, "ETC1S": etc1s.images, "UASTC_LDR_4x4": uastc.images} | dict.fromkeys(astc.HDR, astc.hdr_images)


def _way(source: str | None, target: str) -> None:
    if target not in MADE.get(source, ()):
        raise ValueError(f"no way to {target} from {source or 'plain texels'}")


def images(r: dict, target: str, image: int | None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of a descriptors() row; a fault is an exception."""
    content = bytes(r["content"] or b"")
    if content[:2] == b"sB":
        _way(basis.texture_format(content) or "an unsupported .basis format", target)
        yield from basis.images(content, target, image)
        return
    if r["error"]:
        raise ValueError(r["error"])
    if r["texture_format"] is None and target == "RGBA8":
        _, _, payload, fault = ktx2.plain(r | {"content": content}, image or 0)  # all levels in order, as stored
        if fault:
            raise ValueError(fault)
        yield image or 0, 0, r["width"], r["height"], payload
        return
    _way(r["texture_format"], target)
    if image is not None and not 0 <= image < r["images"]:
        raise ValueError("image index out of range")
    for found in READERS[r["texture_format"]](content, r, target):
        if image in (None, found[0]):
            yield found


def of_bytes(content: bytes, target: str, image: int | None = None) -> Iterator[tuple[int, int, int, int, bytes]]:
    """images() of one container's bytes, without Spark; a fault is an exception."""
    if target not in catalog.TARGETS:
        raise ValueError(f"unknown target {target}")
    row = {} if content[:2] == b"sB" else ktx2.described(content)
    yield from images(row | {"content": content}, target, image)


def _together(rows: list[dict]) -> dict[int, tuple[list[tuple[int, int, int, int]], dict[str, list[bytes]], str | None]]:
    """By place in rows, of small files of stored UASTC blocks: (image, level, width, height), their payloads in each of the
    row's pixel targets, and the fault that ends them. Blocks of images of one size are decoded together; files with a
    block that can't be decoded are left out."""
    out: dict[int, tuple[list, dict, str | None]] = {}
    sizes: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}
    for k, r in enumerate(rows):
        content = r["content"] or b""
        wanted = [t for t in r["targets"] or () if t in catalog.PIXELS]
        if not wanted or r["error"] or r["texture_format"] != "UASTC_LDR_4x4" or r["scheme"] != "NONE" or len(content) > SMALL or content[:2] == b"sB":
            continue
        places, fault = [], None
        try:
            for *place, data in ktx2.block_images(content, r, (4, 4)):
                sizes.setdefault((place[2], place[3]), []).append((k, len(places), data))
                places.append(tuple(place))
        except FAULTS as e:
            fault = str(e) or "malformed"
        out[k] = places, {t: [b""] * len(places) for t in wanted}, fault
    for (w, h), found in sizes.items():
        nx, ny = -(-w // 4), -(-h // 4)
        step = max(1, packers.CHUNK // (nx * ny))
        for at in range(0, len(found), step):
            some = found[at : at + step]
            try:
                texels = uastc.texels(np.frombuffer(b"".join(data for *_, data in some), np.uint8).reshape(-1, 16))
            except ValueError:
                for k, *_ in some:
                    out.pop(k, None)
                continue
            whole = texels.reshape(-1, ny, nx, 4, 4, 4).transpose(0, 1, 3, 2, 4, 5).reshape(-1, ny * 4, nx * 4, 4)[:, :h, :w]
            for target in catalog.PIXELS:
                wanting = [(k, i, j) for j, (k, i, _) in enumerate(some) if k in out and target in out[k][1]]
                if wanting:
                    packed = packers.pack(whole, target)
                    size = len(packed) // len(some)
                    for k, i, j in wanting:
                        out[k][1][target][i] = packed[j * size : (j + 1) * size]
    return out


def results(rows: list[dict], image: int | None = None) -> Iterator[tuple]:
    """OUT rows of descriptors() rows with `targets`, in their order."""
    made = _together(rows) if image is None else {}
    for k, r in enumerate(rows):
        places, payloads, fault = made.get(k, ((), {}, None))
        for target in r["targets"] or ():
            if target in payloads:
                for place, payload in zip(places, payloads[target], strict=True):
                    yield r["path"], *place, target, payload, None
                if fault:
                    yield r["path"], None, None, None, None, target, None, fault
                continue
            try:
                for *place, payload in images(r, target, image):
                    yield r["path"], *place, target, payload, None
            except FAULTS as e:
                yield r["path"], None, None, None, None, target, None, str(e) or "malformed"


def _slices(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    """A batch's rows in lists of at most ROWS rows and HELD bytes of content, or of one row."""
    start = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()):
        if k > start and (held + n > HELD or k - start == ROWS):
            yield batch.slice(start, k - start).to_pylist()
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start).to_pylist()


def transcode(files: DataFrame, target: str, image: int | None = None) -> DataFrame:
    """OUT rows: each image and level of KTX2 and .basis files (path, content) in the target format.

    A container that can't be read, has another kind of source, or has no way to the target, gives a row with the
    fault; images read before it stay. Small files and images are held some at a time, others alone."""
    if target not in catalog.TARGETS:
        raise ValueError(f"unknown target {target}")
    return transcode_each(files, F.array(F.lit(target)), image)


def transcode_each(files: DataFrame, targets: Column, image: int | None = None) -> DataFrame:
    """OUT rows of files (path, content, ...) in each of their own targets, an array; a file is parsed once."""
    files = files.select("path", "content", targets.alias("targets"))
    rows = ktx2.descriptors(ktx2.headers(files)).select("path", "content", "vk_format", "scheme", "images", "width", "height", "levels", "sgd_offset", "sgd_length", "texture_format", "error", "targets")

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), KINDS, strict=True)], list(NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for some in _slices(batch):
                for row in results(some, image):
                    n = len(row[NAMES.index("payload")] or b"")
                    if out and (held + n > HELD or len(out) == ROWS):
                        yield batch_of(out)
                        out, held = [], 0
                    out.append(row)
                    held += n
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, OUT)
