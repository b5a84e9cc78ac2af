"""Bit streams, least significant bit first; past the end come zeros."""

from __future__ import annotations

import struct


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        """The next n bits, at most 32."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        return out

    def truncated(self, n: int) -> int:
        """A truncated binary code of 0..n-1."""
        k = n.bit_length() - 1
        short = (1 << (k + 1)) - n
        v = self.take(k)
        return v if v < short else ((v << 1) | self.take(1)) - short

    def chunked(self, n: int) -> int:
        """Chunks of n bits, each followed by a bit that says whether another comes."""
        out, shift = 0, 0
        while True:
            v = self.take(n + 1)
            out |= (v & ((1 << n) - 1)) << shift
            if not v >> n:
                return out
            shift += n

    def rice(self, n: int) -> int:
        q = 0
        while self.take(1):
            q += 1
        return q << n | self.take(n)


#: Order in which the lengths of the length code are stored; codes above 16 are runs.
LENGTH_ORDER = (17, 18, 19, 20, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15, 16)
#: code: extra bits, least run, whether it repeats the last length (else zeros)
RUNS = {17: (3, 3, False), 18: (7, 11, False), 19: (2, 3, True), 20: (7, 7, True)}


class Huffman:
    """Canonical codes given by their lengths; a code's highest bit comes first in the stream."""

    def __init__(self, lengths: list[int]):
        self.width = max(lengths, default=0)
        if sum(2.0**-n for n in lengths if n) > 1:
            raise ValueError("too many Huffman codes")
        self.lengths = lengths
        self.table: list[tuple[int, int] | None] = [None] * (1 << self.width)
        code = 0
        for n in range(1, self.width + 1):
            for symbol, own in enumerate(lengths):
                if own == n:
                    for k in range(int(f"{code:0{n}b}"[::-1], 2), 1 << self.width, 1 << n):
                        self.table[k] = symbol, n
                    code += 1
            code <<= 1

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek(self.width)] if self.width else None
        if found is None:
            raise ValueError("no such Huffman code")
        bits.at += found[1]
        return found[0]

    @classmethod
    def stored(cls, bits: Bits) -> Huffman:
        """A table as streams carry it: run-length coded lengths under a code of their own."""
        symbols = bits.take(14)
        if not symbols:
            return cls([])
        first = [0] * len(LENGTH_ORDER)
        count = bits.take(5)
        if not 1 <= count <= len(LENGTH_ORDER):
            raise ValueError("bad Huffman table")
        for place in LENGTH_ORDER[:count]:
            first[place] = bits.take(3)
        coder, lengths = cls(first), []
        while len(lengths) < symbols:
            code = coder.read(bits)
            if code <= 16:
                lengths.append(code)
                continue
            extra, least, repeats = RUNS[code]
            if repeats and not (lengths and lengths[-1]):
                raise ValueError("bad Huffman table")
            lengths += [lengths[-1] if repeats else 0] * (bits.take(extra) + least)
        if len(lengths) > symbols:
            raise ValueError("bad Huffman table")
        return cls(lengths)


class MoveToFront:
    """Approximate move-to-front: a used entry swaps with the one at half its place."""

    def __init__(self, size: int):
        self.values = [0] * size
        self.oldest = size // 2

    def add(self, value: int) -> None:
        self.values[self.oldest] = value
        self.oldest += 1
        if self.oldest == len(self.values):
            self.oldest = len(self.values) // 2

    def use(self, place: int) -> int:
        value = self.values[place]
        if place:
            half = place // 2
            self.values[half], self.values[place] = value, self.values[half]
        return value


def hsieh(data: bytes) -> int:
    """Paul Hsieh's SuperFastHash as the format's tools use it: seeded with the length; empty data hash to 0."""
    if not data:
        return 0
    m, n = 0xFFFFFFFF, len(data)
    h, whole = n & m, n & ~3
    for low, high in struct.iter_unpack("<2H", data[:whole]):
        h = (h + low) & m
        h = (h << 16) & m ^ (high << 11) & m ^ h
        h = (h + (h >> 11)) & m
    tail = data[whole:]
    signed = int.from_bytes(tail[-1:], "little", signed=True)
    if len(tail) == 1:
        h = (h + signed) & m
        h ^= h << 10 & m
        h = (h + (h >> 1)) & m
    elif tail:
        h = (h + int.from_bytes(tail[:2], "little")) & m
        if len(tail) == 2:
            h ^= h << 11 & m
            h = (h + (h >> 17)) & m
        else:
            h ^= h << 16 & m
            h ^= signed << 18 & m
            h = (h + (h >> 11)) & m
    for left, right in ((3, 5), (4, 17), (25, 6)):  # spread the last bits
        h ^= h << left & m
        h = (h + (h >> right)) & m
    return h


def crc16(data: bytes, crc: int = 0) -> int:
    """CRC-16 with complement before and after."""
    crc = ~crc & 0xFFFF
    for b in data:
        q = b ^ crc >> 8
        k = q >> 4 ^ q
        crc = (crc << 8 ^ k ^ k << 5 ^ k << 12) & 0xFFFF
    return ~crc & 0xFFFF
