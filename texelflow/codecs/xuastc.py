"""XUASTC LDR payloads as far as they are read here: syntax, sections, image header, and the adaptive arithmetic coder
of their streams (after A. Said's published range coder with adaptive models). Blocks aren't decoded: their modes and
partitions are numbered by large tables that are no part of this package."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

from .bits import Bits

SYNTAXES = ("FULL_ARITH", "HYBRID_ARITH_ZSTD", "FULL_ZSTD")
#: Numbers of 32 bits after the syntax byte: the sections' lengths; FULL_ZSTD has an unused one at the end.
LENGTHS = {"HYBRID_ARITH_ZSTD": 11, "FULL_ZSTD": 21}
#: Names of the sections of FULL_ZSTD, in order; two are stored as they are, the others in Zstandard frames.
SECTIONS = ("raw_bits", "modes", "solid_dpcm", "endpoint_reuse", "use_bc", "dpcm3", "dpcm4", "dpcm5", "dpcm6", "dpcm7", "dpcm8", "mean0", "mean1", "runs", "coefficients", "signs", "weights2", "weights3", "weights4", "weights8")
STORED = ("raw_bits", "signs")
#: Block sizes by code, and the header's marker.
SIZES = ((4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (10, 5), (10, 6), (8, 8), (10, 8), (10, 10), (12, 10), (12, 12))
MARKER = 1


def syntax(data: bytes) -> str:
    if not data or data[0] >= len(SYNTAXES):
        raise ValueError("unsupported XUASTC syntax")
    return SYNTAXES[data[0]]


def lengths(data: bytes) -> list[int]:
    """The sections' lengths; they have to lie within the payload."""
    kind = syntax(data)
    n = LENGTHS.get(kind, 0)
    head = 1 + 4 * n
    if len(data) < head:
        raise ValueError("payload is too small for its header")
    out = np.frombuffer(data, "<u4", n, 1).tolist()
    if head + sum(out) > len(data):
        raise ValueError("sections exceed the payload")
    return out


def sections(data: bytes) -> dict[str, tuple[int, int, int]]:
    """(offset, stored bytes, decoded bytes) of each section of a FULL_ZSTD payload."""
    if syntax(data) != "FULL_ZSTD":
        raise ValueError("not a FULL_ZSTD payload")
    import zstandard

    found, at = {}, 1 + 4 * LENGTHS["FULL_ZSTD"]
    for name, n in zip(SECTIONS, lengths(data), strict=False):
        full = n
        if n and name not in STORED:
            try:
                full = zstandard.frame_content_size(data[at : at + n])
            except zstandard.ZstdError as e:
                raise ValueError(f"section {name}: {e}") from None
            if full < 0:
                raise ValueError(f"section {name} has no decoded size")
        found[name] = at, n, full
        at += n
    return found


@dataclass(frozen=True)
class Header:
    syntax: str
    block: tuple[int, int]
    srgb: bool
    width: int
    height: int
    alpha: bool
    quality: float | None  # of the weights' transform, if there is one


def header(data: bytes) -> Header:
    kind, sizes = syntax(data), lengths(data)
    if kind == "FULL_ZSTD":
        take = Bits(data[1 + 4 * len(sizes) :][: sizes[0]]).take
    else:
        begin = 1 + 4 * len(sizes)
        take = Decoder(data[begin : begin + sizes[0]] if sizes else data[begin:]).bits
    if take(5) != MARKER:
        raise ValueError("no image header")
    size, srgb, width, height = take(4), take(1), take(16), take(16)
    alpha, transformed = take(1), take(1)
    quality = take(8) / 2 if transformed else None
    if size >= len(SIZES) or not width or not height or quality is not None and not 0 < quality <= 100:
        raise ValueError("invalid image header")
    return Header(kind, SIZES[size], bool(srgb), width, height, bool(alpha), quality)


def blocks(data: bytes) -> None:
    """Always a fault: the hybrid syntax has no decoder in the format's own readers, the others have none here."""
    kind = header(data).syntax
    raise ValueError("HYBRID_ARITH_ZSTD blocks are not supported" if kind == "HYBRID_ARITH_ZSTD" else "XUASTC blocks are not decoded here")


# ---- arithmetic coding

TOP, FLOOR = (1 << 32) - 1, 1 << 24  # the range is widened by a byte when it falls below FLOOR
SYMBOL_SHIFT, BIT_SHIFT = 15, 13


def _interval(now: int, least: int, most: int) -> int:
    """How many symbols until the model is worked out again: a quarter more each time."""
    return max(least, min(most, now * 5 >> 2))


class SymbolModel:
    """Adaptive frequencies of 0..n-1, as shares of 2**SYMBOL_SHIFT."""

    def __init__(self, n: int, quick: bool = False):
        if not 2 <= n <= 2048:
            raise ValueError("a model has 2 to 2048 symbols")
        self.n, self.counts, self.interval = n, [1] * n, n
        self.refresh()
        if quick:
            self.interval = self.left = max(4, (n + 7) // 8)

    def refresh(self) -> None:
        while sum(self.counts) >= 1 << SYMBOL_SHIFT:  # halve what has grown too large
            self.counts = [(c + 1) >> 1 for c in self.counts]
        scale, below = (1 << 31) // sum(self.counts), 0
        self.starts = []
        for c in self.counts:
            self.starts.append(scale * below >> (31 - SYMBOL_SHIFT))
            below += c
        self.starts.append(1 << SYMBOL_SHIFT)
        self.interval = self.left = _interval(self.interval, 4, (self.n + 6) << 3)

    def seen(self, symbol: int) -> None:
        self.counts[symbol] += 1
        self.left -= 1
        if self.left <= 0:
            self.refresh()


class BitModel:
    """Adaptive probability of 0, as a share of 2**BIT_SHIFT."""

    def __init__(self) -> None:
        self.zeros, self.all, self.share = 1, 2, 1 << (BIT_SHIFT - 1)
        self.interval = self.left = 4

    def seen(self, bit: int) -> None:
        self.zeros += bit == 0
        self.all += 1
        self.left -= 1
        if self.left <= 0:
            if self.all >= 1 << BIT_SHIFT:
                self.all, self.zeros = (self.all + 1) >> 1, (self.zeros + 1) >> 1
                self.all += self.zeros == self.all
            self.share = self.zeros * ((1 << 31) // self.all) >> (31 - BIT_SHIFT)
            self.interval = self.left = _interval(self.interval, 4, 128)


class GammaModel:
    """Bit models of an Elias gamma code: three of its length, four of its places."""

    def __init__(self) -> None:
        self.prefix, self.tail = [BitModel() for _ in range(3)], [BitModel() for _ in range(4)]

    def length(self, k: int) -> BitModel:
        return self.prefix[min(k, 2)]

    def place(self, k: int) -> BitModel:
        return self.tail[min(k, 3)]


class Decoder:
    """Reads a stream; past its end come zeros."""

    def __init__(self, data: bytes):
        if len(data) < 5:
            raise ValueError("arithmetic stream is too short")
        self.data, self.at, self.value, self.range = data, 4, int.from_bytes(data[:4], "big"), TOP

    def _took(self, low: int, width: int) -> None:
        self.value -= low
        self.range = width
        while self.range < FLOOR:
            self.value = (self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & TOP
            self.range = self.range << 8 & TOP
            self.at += 1

    def bits(self, n: int) -> int:
        """n bits of equal chances, at most 20."""
        if not 1 <= n <= 20:
            raise ValueError("1 to 20 bits at once")
        step = self.range >> n
        v = self.value // step
        self._took(v * step, step)
        return v

    def bit(self, model: BitModel) -> int:
        split = model.share * (self.range >> BIT_SHIFT)
        v = int(self.value >= split)
        self._took(split if v else 0, self.range - split if v else split)
        model.seen(v)
        return v

    def symbol(self, model: SymbolModel) -> int:
        step = self.range >> SYMBOL_SHIFT
        v = bisect_right(model.starts, self.value // step) - 1
        v = min(v, model.n - 1)
        low = step * model.starts[v]
        self._took(low, (self.range if v == model.n - 1 else step * model.starts[v + 1]) - low)
        model.seen(v)
        return v

    def gamma(self, model: GammaModel) -> int:
        n = 0
        while self.bit(model.length(n)):
            n += 1
            if n > 16:
                raise ValueError("gamma code is too long")
        v = 1
        for k in reversed(range(n)):
            v = v << 1 | self.bit(model.place(k))
        return v

    def truncated(self, n: int) -> int:
        """A truncated binary code of 0..n-1."""
        if n < 2:
            raise ValueError("a truncated code has two values at least")
        k = n.bit_length() - 1
        short = (1 << (k + 1)) - n
        v = self.bits(k)
        return v if v < short else (v << 1 | self.bits(1)) - short

    def rice(self, n: int) -> int:
        q = 0
        while self.bits(1):
            q += 1
            if q > 64:
                raise ValueError("Rice code is too long")
        return (q << n) + self.bits(n)


class Encoder:
    """Writes what Decoder reads."""

    def __init__(self) -> None:
        self.out, self.low, self.range = bytearray(), 0, TOP

    def _narrow(self, low: int, width: int) -> None:
        self.low += low
        if self.low > TOP:  # carry into what is written
            self.low &= TOP
            k = len(self.out) - 1
            while self.out[k] == 255:
                self.out[k] = 0
                k -= 1
            self.out[k] += 1
        self.range = width
        while self.range < FLOOR:
            self.out.append(self.low >> 24)
            self.low, self.range = self.low << 8 & TOP, self.range << 8 & TOP

    def bits(self, v: int, n: int) -> None:
        step = self.range >> n
        self._narrow(v * step, step)

    def bit(self, v: int, model: BitModel) -> None:
        split = model.share * (self.range >> BIT_SHIFT)
        self._narrow(split if v else 0, self.range - split if v else split)
        model.seen(v)

    def symbol(self, v: int, model: SymbolModel) -> None:
        step = self.range >> SYMBOL_SHIFT
        low = step * model.starts[v]
        self._narrow(low, (self.range if v == model.n - 1 else step * model.starts[v + 1]) - low)
        model.seen(v)

    def gamma(self, v: int, model: GammaModel) -> None:
        n = v.bit_length() - 1
        for k in range(n):
            self.bit(1, model.length(k))
        self.bit(0, model.length(n))
        for k in reversed(range(n)):
            self.bit(v >> k & 1, model.place(k))

    def truncated(self, v: int, n: int) -> None:
        k = n.bit_length() - 1
        short = (1 << (k + 1)) - n
        if v < short:
            self.bits(v, k)
        else:
            self.bits((v + short) >> 1, k)
            self.bits((v + short) & 1, 1)

    def rice(self, v: int, n: int) -> None:
        for _ in range(v >> n):
            self.bits(1, 1)
        self.bits(0, 1)
        self.bits(v & ((1 << n) - 1), n)

    def done(self) -> bytes:
        self._narrow(self.range >> 1, FLOOR >> 8)  # a value well inside the range
        return bytes(self.out) + self.low.to_bytes(4, "big") + b"\0"
