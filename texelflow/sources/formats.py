"""What a container says of itself beyond its texels: colour space, and flags as sets of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import basis, ktx2

#: Flags of a `.basis` header, (name, bit); other bits are passed over.
HEADER_FLAGS = (("etc1s", 1), ("y_flipped", 2), ("has_alpha_slices", 4), ("uses_global_codebook", 8), ("srgb", 16))
#: Transfer function of a descriptor that means sRGB, and codes of HDR formats, which are linear.
SRGB_TRANSFER, HDR_CODES, HDR_MODELS = 2, (2, 3), (167, 168)


def flag_names(mask: Column, flags: tuple[tuple[str, int], ...]) -> Column:
    """Names of a mask's bits, in order, with commas; unknown bits are passed over."""
    return F.concat_ws(",", *[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in flags])


def known_flags(mask: Column, flags: tuple[tuple[str, int], ...]) -> Column:
    """flag_names(); a mask with an unknown bit is an error."""
    rest = mask.bitwiseAND(F.lit(~sum(bit for _, bit in flags)))
    return F.when(rest == 0, flag_names(mask, flags)).otherwise(F.raise_error(F.concat(F.lit("unknown flag bits: "), mask.cast("string"))))


def colour_space(content: bytes) -> str:
    """sRGB or Linear, by the descriptor's transfer function, the format's code or the header's flag."""
    word = lambda at, n: int.from_bytes(content[at : at + n], "little")
    if content[:2] == b"sB":
        places = {name: (at, n) for name, at, n in basis.HEADER_FIELDS}
        hdr = word(*places["format_code"]) in HDR_CODES
        srgb = not hdr and word(*places["flags"]) & dict(HEADER_FLAGS)["srgb"]
    elif word(52, 4):  # a descriptor
        told = word(word(48, 4) + 12, 4)
        srgb = (told >> 16 & 255) == SRGB_TRANSFER and (told & 255) not in HDR_MODELS
    else:
        srgb = ktx2.PLAIN.get(word(12, 4)) == "SRGB"
    return "sRGB" if srgb else "Linear"
