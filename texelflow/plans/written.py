"""Containers and streams written from known values, to be read back: what the registered queries feed the readers."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

from ..codecs import uastc
from ..codecs.bits import LENGTH_ORDER
from ..sources import basis, ktx2

MODEL = {"ETC1S": 163, "UASTC_LDR_4x4": 166, "UASTC_HDR_4x4": 167, "UASTC_HDR_6x6I": 168, "XUASTC_LDR": 169, "ASTC": 162}


class BitWriter:
    """Least significant bit first."""

    def __init__(self) -> None:
        self.value = self.at = 0

    def put(self, v: int, n: int) -> None:
        self.value |= (v & ((1 << n) - 1)) << self.at
        self.at += n

    def done(self) -> bytes:
        return self.value.to_bytes(-(-self.at // 8), "little")

    def rice(self, v: int, n: int) -> None:
        self.put((1 << (v >> n)) - 1, (v >> n) + 1)
        self.put(v, n)

    def truncated(self, v: int, n: int) -> None:
        k = n.bit_length() - 1
        short = (1 << (k + 1)) - n
        if v < short:
            self.put(v, k)
        else:  # the long code's last bit comes after the others
            self.put((v + short) >> 1, k)
            self.put((v + short) & 1, 1)

    def chunked(self, v: int, n: int) -> None:
        while True:
            rest = v >> n
            self.put(v & ((1 << n) - 1) | (rest > 0) << n, n + 1)
            if not rest:
                return
            v = rest

    def coded(self, symbol: int, size: int) -> None:
        """A canonical code: its highest bit first."""
        self.put(int(f"{symbol:0{size}b}"[::-1], 2), size)

    def flat_table(self, symbols: int) -> int:
        """A stored Huffman table whose codes all have one length, which is returned."""
        if symbols >= 1 << 14:
            raise ValueError("too many symbols for a stored table")
        n = max(1, (symbols - 1).bit_length())
        self.put(symbols, 14)
        self.put(len(LENGTH_ORDER), 5)
        for place in LENGTH_ORDER:  # of the two lengths that get a code, n has the one bit 1
            self.put(place in (0, n), 3)
        for _ in range(symbols):
            self.put(1, 1)
        return n


class Etc1sWriter:
    """Palettes and block streams of end points (r, g, b of 5 bits, intensity) and selectors (16 a row)."""

    HISTORY = 4

    def __init__(self, ends: Sequence[tuple[int, int, int, int]], selectors: np.ndarray):
        self.n_ends, self.n_selectors = len(ends), len(selectors)
        w = BitWriter()
        sizes = [w.flat_table(32) for _ in range(3)]
        level = w.flat_table(8)
        w.put(0, 1)
        last, intensity = [16] * 3, 0
        for *rgb, i in ends:
            w.coded((i - intensity) & 7, level)
            intensity = i
            for c in range(3):
                w.coded((rgb[c] - last[c]) & 31, sizes[sum(last[c] > s for s in (9, 21))])
                last[c] = rgb[c]
        v = BitWriter()
        v.put(0b100, 3)
        for line in selectors.reshape(-1, 4):
            v.put(int(sum(int(x) << 2 * k for k, x in enumerate(line))), 8)
        t = BitWriter()
        self.sizes = [t.flat_table(n) for n in (257, self.n_ends, self.n_selectors + self.HISTORY + 1, 64)]
        t.put(self.HISTORY, 13)
        self.parts = [w.done(), v.done(), t.done()]

    def stream(self, ends: np.ndarray, selectors: np.ndarray) -> bytes:
        """All end points as differences, all selectors as symbols; indexes (ny, nx)."""
        w, last = BitWriter(), 0
        for y, row in enumerate(ends.tolist()):
            for x, e in enumerate(row):
                if not (x | y) & 1:
                    w.coded(0xFF, self.sizes[0])
                w.coded((e - last) % self.n_ends, self.sizes[1])
                last = e
                w.coded(int(selectors[y, x]), self.sizes[2])
        return w.done()

    def copied(self, nx: int, ny: int, new: dict[tuple[int, int], tuple[int, int]] = {}) -> bytes:  # noqa: B006
        """A video frame whose blocks are those of the frame before, but for `new` (y, x): (end point, selector)."""
        w, last, at = BitWriter(), 0, 0
        for y in range(ny):
            for x in range(nx):
                if not (x | y) & 1:
                    w.coded(sum((3 if (y + dy, x + dx) in new else 2) << (4 * dy + 2 * dx) for dy in (0, 1) for dx in (0, 1)), self.sizes[0])
                if (y, x) in new:
                    e, s = new[y, x]
                    w.coded((e - last) % self.n_ends, self.sizes[1])
                    w.coded(s, self.sizes[2])
                    last = e
                else:
                    last = self.before[y, x]
                at += 1
        return w.done()

    before: np.ndarray  # end points of the frame before, for copied()


def ktx2_file(payloads: Sequence[bytes], width: int, height: int, model: int | None = None, block: tuple[int, int] = (4, 4), scheme: int = 0, vk: int = 0, layers: int = 0, full: Sequence[int] | None = None, transfer: int = 1, sgd: bytes = b"") -> bytes:
    """A container with a level a payload, and a descriptor if there is a model."""
    n = len(payloads)
    dfd = b"" if model is None else struct.pack("<3I", 44, 0, 0) + struct.pack("<2I", model | 1 << 8 | transfer << 16, (block[0] - 1) | (block[1] - 1) << 8) + bytes(24)
    at = ktx2.HEADER + 24 * n
    head = bytes.fromhex(ktx2.IDENTIFIER) + struct.pack("<13I2Q", vk, 1, width, height, 0, layers, 1, n, scheme, at if dfd else 0, len(dfd), 0, 0, at + len(dfd) if sgd else 0, len(sgd))
    index, body, at = b"", dfd + sgd, at + len(dfd) + len(sgd)
    for k, p in enumerate(payloads):
        index += struct.pack("<3Q", at, len(p), full[k] if full else len(p))
        body += p
        at += len(p)
    return head + index + body


def etc1s_ktx2(book: Etc1sWriter, colour: bytes, alpha: bytes, width: int, height: int) -> bytes:
    a, b, t = book.parts
    sgd = struct.pack("<2H4I", book.n_ends, book.n_selectors, len(a), len(b), len(t), 0) + struct.pack("<5I", 0, 0, len(colour), len(colour) if alpha else 0, len(alpha)) + a + b + t
    return ktx2_file([colour + alpha], width, height, MODEL["ETC1S"], scheme=1, sgd=sgd)


def basis_file(slices: Sequence[tuple[int, int, int, int, int, bytes]], code: int, kind: int = 0, book: Etc1sWriter | None = None, flags: int = 0) -> bytes:
    """A container of slices (image, level, flags, width, height, data)."""
    parts = book.parts if book else [b""] * 3
    at, places = basis.HEADER + basis.SLICE * len(slices), []
    for p in [*parts, *(s[5] for s in slices)]:
        places.append(at)
        at += len(p)
    values = {"version": 0x13, "slices": len(slices), "images": 1 + max(s[0] for s in slices), "format_code": code, "type_code": kind, "flags": flags, "slice_offset": basis.HEADER}
    if book:
        values |= {"endpoints": book.n_ends, "selectors": book.n_selectors}
        for k, name in enumerate(("endpoint", "selector", "tables")):
            values |= {f"{name}_offset": places[k], f"{name}_size": len(parts[k])}
    head = bytearray(b"sB" + bytes(basis.HEADER - 2))
    for name, place, size in basis.HEADER_FIELDS:
        head[place : place + size] = values.get(name, 0).to_bytes(size, "little")
    table = b"".join(i.to_bytes(3, "little") + bytes([lv, fl]) + struct.pack("<4H2IH", w, h, -(-w // 4), -(-h // 4), o, len(d), 0) for (i, lv, fl, w, h, d), o in zip(slices, places[3:], strict=True))
    return bytes(head) + table + b"".join([*parts, *(s[5] for s in slices)])


def hdr6x6i_stream(width: int, height: int, colours: Sequence[tuple[int, int, int]], runs: Sequence[int]) -> bytes:
    """A 6x6 HDR intermediate stream of blocks of one colour (halves), each followed by a run of so many more."""
    w = BitWriter()
    for v in (0xABCE, width, height):
        w.put(v, 16)
    for colour, run in zip(colours, runs, strict=True):
        w.put(0b100, 3)
        for v in colour:
            w.put(v, 15)
        if run:
            w.put(0b000, 3)
            w.chunked(run - 1, 5)
    w.put(0xA742, 16)
    return w.done()


def uastc_block(k: int, pattern: int, codes: Sequence[int], weights: Sequence[Sequence[int]], second: int, hints: int = 0) -> bytes:
    """A block of mode k: end point codes in order, weights (16, planes), hints of other formats as one number."""
    m = uastc.MODES[k]
    w = BitWriter()
    w.put(m.code, m.size)
    w.put(hints, m.hints)
    anchors = {0}
    if m.pattern_bits:
        seeds = uastc.SEEDS_7 if k == 7 else uastc.SEEDS_3 if m.subsets == 3 else uastc.SEEDS_2
        w.put(pattern, m.pattern_bits)
        subset = uastc.partition(seeds[pattern], m.subsets).tolist()
        anchors = {subset.index(s) for s in range(m.subsets)}
    w.put(second, m.selector_bits)
    bits, trits, quints = uastc.RANGES[m.endpoint_range]
    radix = 3 if trits else 5 if quints else 1
    if radix > 1:
        sizes = uastc.TAILS[radix]
        step = len(sizes) - 1
        for at in range(0, len(codes), step):
            own = [c >> bits for c in codes[at : at + step]]
            w.put(sum(v * radix**j for j, v in enumerate(own)), sizes[len(own)])
    for c in codes:
        w.put(c, bits)
    for t in range(16):
        for p in range(m.planes):
            w.put(weights[t][p], m.weight_bits - (t in anchors))
    return w.done().ljust(16, b"\0")
