"""ETC1S: palettes, block streams, and texels by palette lookup.

The streams must be read in order, one slice a call; what follows from block indexes is done for all blocks at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.pixels import ETC1_MODIFIERS
from . import etc1, packers
from .bits import Bits, Huffman, MoveToFront

REPEAT, REPEAT_LEAST, REPEAT_BITS = 256, 3, 4
RUN_LEAST, RUN_SYMBOLS, RUN_BITS = 3, 64, 7
#: A colour delta's table depends on the value before: up to 9, up to 21, above.
COLOUR_STEPS = (9, 21)


@dataclass
class Codebook:
    """endpoints (n, 4): r, g, b of 5 bits and intensity; selectors (n, 16), row by row; the streams' tables."""

    endpoints: np.ndarray
    selectors: np.ndarray
    prediction: Huffman
    delta: Huffman
    selector: Huffman
    run: Huffman
    history: int


def endpoints(data: bytes, n: int) -> np.ndarray:
    bits = Bits(data)
    colour = [Huffman.stored(bits) for _ in range(3)]
    intensity = Huffman.stored(bits)
    grey = bits.take(1)
    out, last, level = np.zeros((n, 4), np.int64), [16, 16, 16], 0
    for k in range(n):
        level = (level + intensity.read(bits)) & 7
        for c in range(1 if grey else 3):
            table = colour[sum(last[c] > s for s in COLOUR_STEPS)]
            last[c] = (last[c] + table.read(bits)) & 31
        if grey:
            last = [last[0]] * 3
        out[k] = *last, level
    return out


def selectors(data: bytes, n: int) -> np.ndarray:
    bits = Bits(data)
    if bits.take(1) or bits.take(1):
        raise ValueError("global and hybrid selector codebooks are not supported")
    rows = np.zeros((n, 4), np.int64)
    if bits.take(1):
        for k in range(n):
            rows[k] = [bits.take(8) for _ in range(4)]
    elif n:
        table = Huffman.stored(bits)
        rows[0] = [bits.take(8) for _ in range(4)]
        for k in range(1, n):
            rows[k] = [table.read(bits) for _ in range(4)]
        rows = np.bitwise_xor.accumulate(rows, axis=0)
    return (rows[:, :, None] >> (2 * np.arange(4)) & 3).reshape(n, 16)


def codebook(endpoint_data: bytes, n_endpoints: int, selector_data: bytes, n_selectors: int, tables: bytes) -> Codebook:
    bits = Bits(tables)
    four = [Huffman.stored(bits) for _ in range(4)]
    history = bits.take(13)
    if not history:
        raise ValueError("empty selector history")
    return Codebook(endpoints(endpoint_data, n_endpoints), selectors(selector_data, n_selectors), *four, history)


def _predictions(bits: Bits, book: Codebook) -> Iterator[int]:
    """The 8-bit symbol of each 2 x 2 group of blocks, repeats spelled out."""
    last = 0
    while True:
        symbol = book.prediction.read(bits)
        if symbol == REPEAT:
            for _ in range(bits.chunked(REPEAT_BITS) + REPEAT_LEAST):
                yield last
        else:
            last = symbol
            yield last


def _selector_symbols(bits: Bits, book: Codebook) -> Iterator[int]:
    """The selector of each block that codes one."""
    n, history = len(book.selectors), MoveToFront(book.history)
    while True:
        symbol = book.selector.read(bits)
        if symbol < n:
            history.add(symbol)
            yield symbol
        elif symbol < n + book.history:
            yield history.use(symbol - n)
        else:
            run = book.run.read(bits)
            for _ in range(RUN_LEAST + (bits.chunked(RUN_BITS) if run == RUN_SYMBOLS - 1 else run)):
                yield history.use(0)


def blocks(data: bytes, book: Codebook, nx: int, ny: int, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Endpoint and selector indexes (ny, nx) of a slice; `before`: those of a video's frame before."""
    bits = Bits(data)
    groups, chosen = _predictions(bits, book), _selector_symbols(bits, book)
    e, s = np.zeros((ny, nx), np.int64), np.zeros((ny, nx), np.int64)
    symbols = [0] * (-(-nx // 2))
    last, n = 0, len(book.endpoints)
    for y in range(ny):
        for x in range(nx):
            if not (x | y) & 1:
                symbols[x // 2] = next(groups)
            kind = symbols[x // 2] >> (4 * (y & 1) + 2 * (x & 1)) & 3
            copied = kind == 2 and before is not None
            if copied:
                last, s[y, x] = before[0][y, x], before[1][y, x]
            elif kind == 3:
                last = (last + book.delta.read(bits)) % n
            else:
                from_x, from_y = x - (kind != 1), y - (kind != 0)
                if from_x < 0 or from_y < 0:
                    raise ValueError("endpoint predicted from outside the image")
                last = e[from_y, from_x]
            e[y, x] = last
            if not copied:
                s[y, x] = next(chosen)
    if nx * ny and s.max() >= len(book.selectors):
        raise ValueError("selector index out of range")
    return e, s


def finished(colour: tuple[np.ndarray, np.ndarray], alpha: tuple[np.ndarray, np.ndarray] | None, book: Codebook, width: int, height: int, target: str) -> bytes:
    """A slice, and its alpha slice if there is one, in the target format. ETC1 blocks keep palette entries as they are."""
    ny, nx = colour[0].shape
    etc = target in ("ETC1", "ETC2", "ETC2_NO_ALPHA")
    own = etc1.of_palette(book.endpoints[colour[0]].reshape(-1, 4), book.selectors[colour[1]].reshape(-1, 16)) if etc else None
    if etc and target != "ETC2":
        return own.tobytes()
    whole = colours(*colour, book, nx * 4, ny * 4)
    if alpha is not None:  # alpha is the red of its own slice
        whole[..., 3] = colours(*alpha, book, nx * 4, ny * 4)[..., 0]
    if etc:
        return np.concatenate([packers.eac(packers.blocks(whole[..., 3])), own], axis=1).tobytes()
    return packers.finish(whole, width, height, target)


def colours(e: np.ndarray, s: np.ndarray, book: Codebook, width: int, height: int) -> np.ndarray:
    """RGBA bytes (height, width, 4) by palette lookup, cropped to the image."""
    ends = book.endpoints[e]
    base = ends[..., :3] << 3 | ends[..., :3] >> 2
    shift = np.array(ETC1_MODIFIERS)[ends[..., 3][..., None], book.selectors[s]]
    texels = np.clip(base[:, :, None, :] + shift[..., None], 0, 255).astype(np.uint8)  # ny, nx, 16, 3
    ny, nx = e.shape
    out = np.full((ny * 4, nx * 4, 4), 255, np.uint8)
    out[..., :3] = texels.reshape(ny, nx, 4, 4, 3).transpose(0, 2, 1, 3, 4).reshape(ny * 4, nx * 4, 3)
    return out[:height, :width]


#: Bytes before the image descriptors of a KTX2 container's global data, and of a descriptor.
GLOBAL, DESCRIPTOR = 20, 20


def global_data(content: bytes, header: dict) -> tuple[int, int, list[bytes], list[tuple[int, ...]]]:
    """(end points, selectors, their and the tables' bytes, image descriptors); a fault is a ValueError."""
    at, room = header["sgd_offset"], header.get("sgd_length")
    room = len(content) - at if room is None else room
    count = header["images"] * header["levels"]
    word = lambda p, n: int.from_bytes(content[p : p + n], "little")
    if at + room > len(content) or room < GLOBAL + DESCRIPTOR * count:
        raise ValueError("global data are too short")
    n_end, n_sel = word(at, 2), word(at + 2, 2)
    sizes = [word(at + 4 + 4 * k, 4) for k in range(4)]
    if not n_end or not n_sel or not all(sizes[:3]):
        raise ValueError("empty palettes or tables")
    described = [tuple(word(at + GLOBAL + DESCRIPTOR * d + 4 * k, 4) for k in range(5)) for d in range(count)]
    if not all(d[2] for d in described):
        raise ValueError("empty colour slice")
    parts, p = [], at + GLOBAL + DESCRIPTOR * count
    if p + sum(sizes) > at + room:
        raise ValueError("palettes past the global data")
    for n in sizes[:3]:
        parts.append(content[p : p + n])
        p += n
    return n_end, n_sel, parts, described


def images(content: bytes, header: dict, target: str = "RGBA8") -> Iterator[tuple[int, int, int, int, bytes]]:
    """(image, level, width, height, payload) of a KTX2 container with this colour model."""
    from ..sources.ktx2 import level_ranges

    n_end, n_sel, parts, described = global_data(content, header)
    book = codebook(parts[0], n_end, parts[1], n_sel, parts[2])
    for level, (start, size, _) in enumerate(level_ranges(content, header["levels"])):
        w, h = max(1, header["width"] >> level), max(1, header["height"] >> level)
        for image in range(header["images"]):
            _, rgb, rgb_n, alpha, alpha_n = described[level * header["images"] + image]
            if rgb + rgb_n > size or alpha + alpha_n > size:
                raise ValueError("slice past its level")
            nx, ny = -(-w // 4), -(-h // 4)
            colour = blocks(content[start + rgb :][:rgb_n], book, nx, ny)
            opacity = blocks(content[start + alpha :][:alpha_n], book, nx, ny) if alpha_n else None
            yield image, level, w, h, finished(colour, opacity, book, w, h, target)


def decoded(rows: DataFrame) -> DataFrame:
    """path, image, level, width, height, rgba, error of descriptors() rows of this format; a fault is a row's own."""
    wanted = rows.filter("error is null and texture_format = 'ETC1S'").select("path", "content", "sgd_offset", "sgd_length", "images", "levels", "width", "height")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    out = [(r["path"], *x, None) for x in images(r["content"], r)]
                except (ValueError, IndexError, StopIteration, ZeroDivisionError) as e:
                    out = [(r["path"], None, None, None, None, None, str(e) or "malformed")]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["path", "image", "level", "width", "height", "rgba", "error"])

    return wanted.mapInArrow(run, "path string, image int, level int, width int, height int, rgba binary, error string")
