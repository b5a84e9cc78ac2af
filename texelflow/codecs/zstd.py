"""Zstandard frames: several in a row, skippable ones among them; checksums aren't needed to decode."""

from __future__ import annotations

import zstandard


def decompress(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        if data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] >> 4 == 5:  # a skippable frame
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        d = zstandard.ZstdDecompressor().decompressobj()
        out.append(d.decompress(data[at:]))
        if not d.eof:
            raise ValueError("truncated zstd frame")
        at = len(data) - len(d.unused_data)
    return b"".join(out)
